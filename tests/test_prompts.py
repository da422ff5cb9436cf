"""Prompts: similarities are rounded as printf does."""

from pyspark.sql import functions as F

from casewell.operators import responses


def test_similarity_is_rounded_by_its_exact_value(spark):
    values = [0.485, 0.125, 0.575, 0.615, 0.375, -0.001, 1.0]
    found = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "query_id long, similarity double")
    hit = F.struct(F.lit("t").alias("thread_id"), F.lit("m").alias("customer_msg"), F.lit("r").alias("brand_reply"), "similarity", F.lit(False).alias("is_deflection"))
    rows = found.select("query_id", F.lit("m").alias("customer_msg"), F.array(hit).alias("exemplars"))
    got = {r.query_id: r.prompt for r in responses.build_prompts(rows, "classes").collect()}
    assert all(f"(similarity {'%.2f' % v})" in got[i] for i, v in enumerate(values))
