"""What a search is made from is made once: the index of a stream's history, and the queries; texts that no query has stay."""

import numpy as np
from pyspark.sql import functions as F

from casewell.operators import pivots, vectors
from casewell.plans import inputs
from casewell.streaming import stream


def _rows(spark, n, seed=5):
    m = np.random.default_rng(seed).standard_normal((n, 4))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vector array<double>")


def test_batches_of_a_stream_share_one_index(spark, monkeypatch, tmp_path):
    made = []

    class Counted(pivots.PivotIndex):
        def __init__(self, corpus, *args):
            made.append(1)
            super().__init__(corpus, *args)

    monkeypatch.setattr(vectors, "CORPUS_BLOCK", 50)
    monkeypatch.setattr(vectors, "PivotIndex", Counted)
    rows = _rows(spark, 200)
    messages = rows.select(F.col("id").alias("conv_id"), F.lit(1).alias("turn"), F.lit("hello").alias("text"), F.lit(False).alias("never_auto"))
    for part in range(3):
        messages.where(F.col("id") % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    held, history = rows.withColumnRenamed("id", "conv_id"), vectors.Neighbours(rows)
    judge = lambda batch: stream.route_batch(batch, held, history, "conv_id", least=0.9).select("conv_id", "similarity", "triggered_rule")
    stream.run_batches(source, judge, "shared-index", str(tmp_path / "state"), str(tmp_path / "out"))
    got = {r.conv_id: r for r in spark.read.parquet(f"{tmp_path}/out/*").collect()}
    assert len(list((tmp_path / "out").glob("batch=*"))) == 3 and len(got) == 200
    assert len(made) == 1
    m = pivots.unit(np.array(rows.orderBy("id").toPandas().vector.tolist()))
    s = m @ m.T
    np.fill_diagonal(s, -1)
    assert all(abs(got[i].similarity - s[i].max()) < 1e-9 for i in range(200))
    assert all(got[i].triggered_rule == ("rules_only" if s[i].max() >= 0.9 else "low_retrieval_similarity") for i in range(200))


def test_queries_are_made_once(spark):
    rows, seen = _rows(spark, 300), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    asked = rows.where("id < 20").withColumnRenamed("id", "query_id").mapInArrow(counted, "query_id long, vector array<double>")
    assert pivots.ranked(pivots.PivotIndex(rows, 32).search(asked, 3), 3).count() == 60
    assert seen.value == 20


def test_pool_documents_hold_every_query_and_few_others(spark, sf):
    kept = inputs.pool_documents(spark, sf)
    every = inputs.table(spark, sf, "documents")
    asked = inputs.split_vectors(spark, sf)[0].select(F.col("query_id").alias("doc_id"))
    assert kept.join(asked, "doc_id").count() == every.join(asked, "doc_id").count() > 0
    assert 0 < kept.count() < 0.2 * every.count()
    assert "bucket" not in kept.columns and kept.where("text is null").count() <= every.where("text is null").count()
