"""Draft defects: a draft is built and folded once, whatever the number of conditions on it."""

from casewell.plans import catalogue


def test_drafts_and_folds_are_made_once(spark, sf):
    plan = catalogue.QUERIES["t17_draft_defects"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1 and plan.count("We will update you") == 1
