"""Operator 12: held-out accuracy, plain recomputation, few labels, awkward tables."""

import zlib

import numpy as np
import pytest
import zstandard

from casewell.llm import op12_compression_quality as op12

ROWS = "doc_id long, text string, lang string, quality int, x double"


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def scored(spark):
    d = "/root/testdata/sf0.1"
    return op12.query(spark, d).toPandas(), spark.read.parquet(f"{d}/labels.parquet").toPandas()


def test_held_out_rows_are_told_apart(scored):
    got, labels = scored
    assert len(got) == 10000 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    assert (got.held_out == got.doc_id.map(held)).all()
    both = got[got.held_out].merge(labels, on="doc_id")
    good = both.quality == 1
    assert (both.predicted == both.quality).mean() > 0.96 and both[good].predicted.mean() > 0.98
    ranks = both.score.rank()
    assert (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum()) > 0.97
    assert abs(both.score.mean() - both.quality.mean()) < 0.05  # calibrated in the large


def test_labels_of_held_out_rows_change_nothing(spark, sf):
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("quality", F.when(op12.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert op12.fit(docs, labels) == op12.fit(docs, other)


def test_advantage_equals_plain_compression():
    good, bad = op12.dictionary([b"plain words of prose " * 20] * 3), op12.dictionary([b"LOUD!! NOISE!! " * 20] * 3)
    texts = ["", "plain words", "LOUD!! NOISE!! " * 500, "ü" * 5000]
    for text, got in zip(texts, op12.advantage(texts, good, bad)):
        data, sums = text.encode(), []
        for content in (good, bad):
            c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content), level=3, write_content_size=False, write_dict_id=False)
            sums.append(sum(len(c.compress(data[i : i + 2048])) for i in range(0, len(data), 2048)))
        assert got == pytest.approx((sums[1] - sums[0]) / (len(data) + op12.SHRINK))


def test_curve_is_monotone_and_near_the_rates():
    draw = np.random.default_rng(3)
    x = draw.normal(size=4000)
    y = draw.random(4000) < 1 / (1 + np.exp(-(2 * x + 1)))
    slope, middle = op12.logistic_curve(x, y)
    assert slope == pytest.approx(2, abs=0.25) and middle == pytest.approx(1, abs=0.2)
    assert op12.logistic_curve(x, ~y)[0] == 0


@pytest.mark.parametrize("n, least", [(22, 0.75), (50, 0.9), (200, 0.95)])
def test_few_labels_keep_clean_documents(spark, scored, n, least):
    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    some = [labels.where((F.col("quality") == q) & ~op12.held_out()).orderBy(F.xxhash64("doc_id", F.lit(n))).limit(n) for q in (0, 1)]
    got = op12.score(docs, some[0].unionByName(some[1])).toPandas().merge(scored[1], on="doc_id")
    assert got[got.quality == 1].predicted.mean() > least


def test_awkward_tables(spark):
    long = "words of a very long text that goes on " * 40000
    rows = [(1, None), (2, ""), (3, " \n "), (4, long), (4, long), (None, "no id"), (5, "ok text"), (6, "BAD!! BAD!!")]
    docs = spark.createDataFrame([(i, t, "en", 1, 0.5) for i, t in rows], ROWS)
    labels = spark.createDataFrame([(5, 1), (6, 0), (6, None), (None, 1)], "doc_id long, quality int")
    got = op12.score(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    none = op12.score(docs, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5} and {r.predicted for r in none} == {1}
    assert op12.score(docs.where("false"), labels).count() == 0
