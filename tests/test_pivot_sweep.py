"""The second look of the pivot index: queries do not move to shells, and several packs, bundles and copies agree with brute force."""

import numpy as np
from pyspark.sql import functions as F
from test_pivots import brute

from casewell.operators import pivots


def _frames(spark, q, m):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vector array<double>")
    return rows, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, vector array<double>")


def test_packs_and_bundles_equal_brute_force(spark, monkeypatch):
    for name, value in {"SWEPT": 20, "BUNDLE": 150, "PARTS": 2, "PAIRS": 64}.items():
        monkeypatch.setattr(pivots, name, value)
    draw = np.random.default_rng(11)
    m = draw.standard_normal((600, 8))
    m[200:280] = m[7]  # more copies than any look keeps
    q = np.vstack([m[:25], draw.standard_normal((10, 8))])
    rows, asked = _frames(spark, q, m)
    got = {}
    for r in pivots.ranked(pivots.PivotIndex(rows, 40).search(asked, 4), 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == brute(q, m, 4)


def test_a_search_moves_no_query_to_shells(spark):
    draw = np.random.default_rng(12)
    rows, asked = _frames(spark, draw.standard_normal((5, 4)), draw.standard_normal((300, 4)))
    plan = pivots.PivotIndex(rows, 32).search(asked, 3).select(F.col("id"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "CartesianProduct" in plan
