"""Every registered query runs; where it has SQL, another engine gives the same rows."""

import pytest
from compare import engine, same

from casewell.plans import catalogue


@pytest.fixture(scope="module")
def con(sf):
    return engine(sf)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_as_sql(spark, sf, con, name):
    same(catalogue.QUERIES[name](spark, sf), con.sql(catalogue.ORACLE_SQL[name]).df())


def test_bootstrap_brackets_the_estimate(spark, sf):
    from casewell.plans import inputs

    rows = inputs.outputs(spark, sf).where("system = 'agent'").toPandas()
    found = {r.statistic: r for r in catalogue.QUERIES["g29_bootstrap_ci"](spark, sf).collect()}
    assert found["accuracy"].low < (rows.gold == rows.pred).mean() < found["accuracy"].high


def test_svd_equals_numpy(spark):
    import numpy as np

    from casewell.operators import vectors

    rng = np.random.default_rng(0)
    m = rng.standard_normal((300, 6)) @ rng.standard_normal((6, 20)) + 0.01 * rng.standard_normal((300, 20))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vector array<double>")
    basis = np.linalg.svd(m, full_matrices=False)[2][:6].T
    want = m @ basis
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    got = np.array(vectors.svd_project(rows, rows, 6).orderBy("id").toPandas().vector.tolist())
    assert got.shape == (300, 6) and np.allclose(got @ got.T, want @ want.T, atol=1e-8)
    assert vectors.svd_project(rows.where("false"), rows.where("false"), 6).count() == 0


def test_text_retrieval_finds_copies(spark, sf):
    rows = catalogue.QUERIES["m3_svd_project"](spark, sf).toPandas()
    assert (rows.groupby("query_id").size() == 5).all() and rows.similarity.between(-1.001, 1.001).all()
    assert all(part.sort_values("rank").similarity.is_monotonic_decreasing for _, part in rows.groupby("query_id"))


def test_out_of_fold_predicts_each_row_once_and_well(spark, sf):
    rows = catalogue.QUERIES["m6_logreg_oof"](spark, sf).toPandas()
    n = spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null").count()
    assert rows.id.is_unique and len(rows) == n and set(rows.fold) == {0, 1, 2, 3, 4}
    assert (rows.label == rows.pred).mean() > 0.8


def test_neighbours_equal_brute_force_in_blocks(spark, monkeypatch):
    import numpy as np

    from casewell.operators import vectors

    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vectors, "CORPUS_BLOCK", 40)
    rng = np.random.default_rng(3)
    m = np.round(rng.standard_normal((200, 3)), 0) + [0, 0, 0.5]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vector array<double>")
    got = {}
    for r in vectors.knn_topk(rows.where("id < 20").withColumnRenamed("id", "query_id"), rows, 4).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(20):
        s = (u @ u[q]).round(12)
        assert [got[q][k] for k in (1, 2, 3, 4)] == sorted(range(200), key=lambda i: (-s[i], i))[:4]


def test_curation_does_not_sort_dropped_rows_together(spark, sf):
    plan = catalogue.QUERIES["f1_curation_cascade"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_sample_reads_its_pool_a_few_times(spark, sf):
    plan = catalogue.QUERIES["w6_stratified_sample"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 3


def test_kmeans_and_sweep(spark, sf):
    assert catalogue.QUERIES["m4_kmeans"](spark, sf).select("cluster").distinct().count() == 10
    sweep = catalogue.QUERIES["m5_choose_k"](spark, sf).toPandas()
    best = sweep.sort_values(["silhouette", "k"], ascending=[False, True]).iloc[0]
    assert sweep.chosen.sum() == 1 and sweep[sweep.chosen].k.iloc[0] == best.k


def test_sweep_tries_every_k_of_the_survey(spark, sf):
    assert [r.k for r in catalogue.QUERIES["m5_choose_k"](spark, sf).orderBy("k").collect()] == list(range(8, 24, 2))


def test_kmeans_does_four_restarts(spark, sf, monkeypatch):
    from casewell.operators import sweep

    seeds, fits = [], sweep.fits
    monkeypatch.setattr(sweep, "fits", lambda rows, ks, own: seeds.extend(own) or fits(rows, ks, own))
    catalogue.QUERIES["m4_kmeans"](spark, sf)
    assert len(set(seeds)) == 4


def test_outputs_follow_their_tables(spark, sf, tmp_path):
    import shutil

    from casewell.plans import inputs

    for name in ("embeddings", "documents", "labels"):
        shutil.copy(f"{sf}/{name}.parquet", tmp_path / f"{name}.parquet")
    before = inputs.outputs(spark, str(tmp_path)).count()
    some = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").limit(60).toPandas()
    some.to_parquet(tmp_path / "embeddings.parquet")
    spark.catalog.refreshByPath(str(tmp_path / "embeddings.parquet"))
    assert before > inputs.outputs(spark, str(tmp_path)).count() == 120


def test_stream_dedupe_drops_repeats(spark, sf):
    rows = catalogue.QUERIES["x2_stream_dedupe"](spark, sf)
    total = spark.read.parquet(f"{sf}/events.parquet").count()
    assert rows.select("dedupe_key").distinct().count() <= rows.count() < total
