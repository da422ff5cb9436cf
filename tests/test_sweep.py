"""The k sweep in shared scans, exact bootstrap draws, responses as VARIANT, state of streams."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from casewell.operators import bootstrap, models, responses, sweep
from casewell.streaming import stream


@pytest.fixture(scope="module")
def points(spark):
    draw = np.random.default_rng(5)
    m = np.vstack([c + 0.3 * draw.standard_normal((80, 6)) for c in 3 * draw.standard_normal((9, 6))])
    return m, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vector array<double>").repartition(5).cache()


def lloyd(m, centres, rounds):
    for _ in range(rounds):
        own, _ = sweep.nearest(m, centres)
        new = np.array([m[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
        moved = np.sqrt(((new - centres) ** 2).sum(axis=1)).max()
        centres = new
        if moved <= sweep.STILL:
            break
    return centres, sweep.nearest(m, centres)[1].sum()


def test_shared_scans_equal_separate_fits(points, monkeypatch):
    m, rows = points
    scans, scan = [], sweep._scan
    monkeypatch.setattr(sweep, "_scan", lambda *a, **k: scans.append(1) or scan(*a, **k))
    found = sweep.fits(rows, list(range(8, 24, 2)), [42, 43, 44, 45])
    assert len(found) == 32 and len(scans) <= 18
    sample = np.array(rows.orderBy(F.xxhash64("id"), "id").toPandas().vector.tolist())
    for (k, s), (centres, cost) in found.items():
        want, least = lloyd(m, sweep.start(sample, k, s), sweep.ROUNDS)
        assert cost == pytest.approx(least) and np.allclose(centres, want)


def test_silhouettes_equal_the_evaluator(points):
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    m, rows = points
    centres = sweep.fits(rows, [9], [1])[9, 1][0]
    marked = rows.join(sweep.assigned(rows, centres), "id").withColumn("features", array_to_vector("vector")).withColumn("prediction", F.col("cluster").cast("double"))
    want = ClusteringEvaluator(distanceMeasure="cosine").evaluate(marked)
    assert sweep.silhouettes(rows, {0: centres})[0] == pytest.approx(want, abs=1e-9)


def test_sweep_of_nothing_and_choice(points, spark):
    _, rows = points
    got = models.choose_k(rows, [4, 9, 14]).toPandas()
    assert got[got.chosen].k.tolist() == got[got.silhouette == got.silhouette.max()].k.tolist()[:1]
    assert models.choose_k(rows.where("false")).count() == 0 and models.kmeans_assign(rows.where("false"), 3).count() == 0


def test_draws_are_poisson_and_merge(spark):
    keys = np.random.default_rng(1).integers(0, bootstrap.PRIME, 3000)
    w = bootstrap.draws(keys, np.arange(400))
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.15
    draw = np.random.default_rng(2)
    x, under = draw.normal(5, 2, 1500), draw.integers(1, 9, 1500)
    rows = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(x, under))], "id long, x double, n int")
    one, many = (bootstrap.ratio_ci(rows.repartition(n), "id", F.col("x")).first() for n in (1, 7))
    assert one.n == 1500 and abs(one.low - many.low) < 1e-9 and abs(one.high - many.high) < 1e-9
    se = x.std() / 1500**0.5
    assert one.low == pytest.approx(x.mean() - 1.96 * se, abs=0.4 * se) and one.high == pytest.approx(x.mean() + 1.96 * se, abs=0.4 * se)
    ratio = bootstrap.ratio_ci(rows, "id", F.col("x"), F.col("n")).first()
    again = [(x[at].sum() / under[at].sum()) for at in draw.integers(0, 1500, (2000, 1500))]
    assert np.allclose([ratio.low, ratio.high], np.percentile(again, [2.5, 97.5]), rtol=0.02)
    empty = bootstrap.ratio_ci(rows.where("false"), "id", F.col("x")).first()
    assert empty.n == 0 and np.isnan(empty.low)


def test_one_field_of_the_wrong_type_spoils_no_other(spark):
    texts = ['{"intent": "c1", "confidence": {"no": "number"}, "reply": "ok", "grounded_in": "E1", "uncertain": "maybe"}', "[1, 2]", "not json", '```json\n{"intent": "c2", "confidence": 0.5}\n```', None]
    rows = responses.with_parsed(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, response string")).drop("response")
    got = {r.id: r for r in responses.validate_classification(rows, ["c1", "c2"], "parsed").collect()}
    assert (got[0].intent, got[0].ok, got[0].confidence) == ("c1", True, 0.0) and (got[3].intent, got[3].confidence) == ("c2", 0.5)
    assert [got[i].error for i in (1, 2, 4)] == ["unparseable"] * 3
    draft = {r.id: r for r in responses.validate_draft(rows, "parsed").collect()}
    assert draft[0].reply == "ok" and draft[0].grounded_in == [] and not draft[0].uncertain and draft[0].draft_ok
    plan = responses.validate_draft(responses.validate_classification(rows.withColumn("draft", F.col("parsed")), ["c1"], "parsed"), "draft")
    assert plan._jdf.queryExecution().analyzed().toString().count("try_parse_json") == 1


def test_recorded_responses_are_not_moved(spark):
    known = responses.response_table(spark.range(500).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), F.lit("{}").alias("response")))
    requests = spark.range(900).select(F.col("id").alias("request_id"), F.array(F.struct(F.lit("a").alias("provider"), F.sha2(F.col("id").cast("string"), 256).alias("key"))).alias("chain"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = responses.resolve_responses(requests, known)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert found.where("provider is not null").count() == 500 and found.count() == 900
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(key") == 1  # the requests' side alone


def test_the_earliest_wins_although_it_arrives_later(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    at = lambda s: pd.Timestamp(f"2024-01-01 {s}")
    batches = [
        [(1, at("10:05:00"), "same text"), (2, at("10:05:30"), "other text")],
        [(3, at("10:01:00"), "same text"), (4, at("10:20:00"), "same text"), (5, at("10:01:00"), "same text")],
        [(6, at("10:00:00"), "late and dropped"), (7, at("12:00:00"), "closing")],
        [(8, at("12:30:00"), "closing again")],
    ]
    schema = "id long, time timestamp, text string"
    sink, state = str(tmp_path / "out"), str(tmp_path / "state")
    for k, rows in enumerate(batches):  # one run of the stream per file, over the same state
        pd.DataFrame(rows, columns=["id", "time", "text"]).astype({"time": "datetime64[us]"}).to_parquet(source / f"{k}.parquet")
        live = spark.readStream.schema(schema).parquet(str(source))
        found = stream.run_to_end(stream.stream_dedupe(live, "text", "time", "id", "10 minutes", "10 minutes"), f"first-{k}", state, sink)
    got = sorted(r.id for r in found.collect())
    assert got == [2, 3, 4, 7]  # 1 and 5 fall to 3; 4 is a horizon later; 8 waits for the watermark; 6 came too late
