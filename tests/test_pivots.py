"""The pivot index against brute force: ties, rows of no length, clusters, few rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewell.operators import pivots


def brute(q, m, k):
    u = pivots.unit(m)
    out = {}
    for i, v in enumerate(pivots.unit(q)):
        s = np.round(u @ v, 12)
        out[i] = [int(j) for j in np.lexsort((np.arange(len(u)), -s))[:k]]
    return out


def found(spark, q, m, k, shell):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vector array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, vector array<double>")
    index = pivots.PivotIndex(rows, shell)
    out = {}
    for r in pivots.ranked(index.search(asked, k), k).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.id)
    return index, asked, out


@pytest.mark.parametrize("shell", [7, 100])
def test_index_equals_brute_force_with_ties(spark, shell):
    draw = np.random.default_rng(shell)
    m = np.round(draw.standard_normal((1500, 3)) * 2) / 2
    m[::50] = 0
    q = np.vstack([m[:30], draw.standard_normal((10, 3)), np.zeros((1, 3))])
    _, _, got = found(spark, q, m, 4, shell)
    assert got == brute(q, m, 4)


def test_clustered_corpus_is_mostly_left_out(spark):
    draw = np.random.default_rng(1)
    centres = draw.standard_normal((60, 24))
    m = centres[draw.integers(0, 60, 6000)] + 0.08 * draw.standard_normal((6000, 24))
    q = m[:120] + 0.02 * draw.standard_normal((120, 24))
    index, asked, got = found(spark, q, m, 5, 64)
    assert got == brute(q, m, 5)
    first = index.visits(asked.withColumn("reach", F.lit(None).cast("double"))).agg(F.sum("n")).first()[0]
    s = pivots.unit(q) @ pivots.unit(m).T
    reach = np.sqrt(np.maximum(0, 2 - 2 * -np.sort(-s, axis=1)[:, 4]))
    far = spark.createDataFrame([(i, float(r)) for i, r in enumerate(reach)], "query_id long, reach double")
    rest = index.visits(asked.join(far, "query_id")).agg(F.sum("n")).first()[0] or 0
    assert (first + rest) / (120 * 6000) < 0.3


def test_corpus_is_not_moved_by_a_search(spark):
    draw = np.random.default_rng(2)
    index, asked, _ = found(spark, draw.standard_normal((5, 4)), draw.standard_normal((400, 4)), 3, 32)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = index._visit(asked.withColumn("reach", F.lit(None).cast("double")), 3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    side = plan[plan.index("FileScan parquet") - 400 : plan.index("FileScan parquet")] if "FileScan parquet" in plan else plan
    assert "Bucketed: true" in plan and "Exchange" not in side[side.rfind("Filter") :]


def test_few_and_no_rows(spark):
    q = np.ones((3, 4))
    for n in (0, 1, 3):
        _, _, got = found(spark, q, np.random.default_rng(n).standard_normal((n, 4)), 5, 2) if n else (None, None, {})
        assert all(len(v) == n for v in got.values())
    none = spark.createDataFrame([], "id long, vector array<double>")
    assert pivots.PivotIndex(none).search(spark.createDataFrame([(1, [1.0])], "query_id long, vector array<double>"), 5).count() == 0


def test_large_corpora_take_the_index(spark, monkeypatch):
    from casewell.operators import vectors

    draw = np.random.default_rng(9)
    m = np.round(draw.standard_normal((300, 3)), 1)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vector array<double>")
    asked = rows.where("id < 25").select(F.col("id").alias("query_id"), "vector")
    plain = sorted(map(tuple, vectors.knn_topk(asked, rows, 4).select("query_id", "id", "rank").collect()))
    monkeypatch.setattr(vectors, "CORPUS_BLOCK", 50)
    assert sorted(map(tuple, vectors.knn_topk(asked, rows, 4).select("query_id", "id", "rank").collect())) == plain
