"""Evaluation measures as aggregations. Rates keep full precision; a zero denominator gives 0 where stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .position import running_sum


def over(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is 0."""
    return F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def gold_vs_pred(gold: DataFrame, pred: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One prediction per gold row; a missing one raises when the rows are read."""
    joined = gold.join(pred.withColumn("there_", F.lit(True)), key, "left")
    checked = F.when(F.col("there_").isNull(), F.raise_error(F.concat(F.lit("no prediction for "), F.col(key).cast("string")))).otherwise(F.col(key))
    return joined.withColumn(key, checked).select(key, *columns)


def label_universe(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    gold, pred = (rows.select(*by, F.col(c).alias("label")) for c in ("gold", "pred"))
    return gold.union(pred).distinct()


def confusion_counts(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    return rows.groupBy(*by, "gold", "pred").agg(F.count("*").alias("n"))


def confusion_matrix(rows: DataFrame) -> DataFrame:
    """gold, pred, n for every pair of labels, zeros included. Labels are few: the square is of classes, not rows."""
    labels = label_universe(rows)
    square = labels.select(F.col("label").alias("gold")).join(labels.select(F.col("label").alias("pred")), F.lit(True))
    return square.join(confusion_counts(rows), ["gold", "pred"], "left").select("gold", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def per_class_report(rows: DataFrame, by: list[str] = (), labels: DataFrame | None = None) -> DataFrame:
    """label, precision, recall, f1, support; rows (gold, pred)."""
    by = list(by)
    cells = confusion_counts(rows, by)
    sides = F.explode(F.array(F.struct(F.col("gold").alias("label"), F.lit("gold").alias("side")), F.struct(F.col("pred").alias("label"), F.lit("pred").alias("side"))))
    per = cells.select(*by, "n", (F.col("gold") == F.col("pred")).alias("hit"), sides.alias("x")).groupBy(*by, F.col("x.label").alias("label")).agg(
        F.sum(F.when((F.col("x.side") == "gold") & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("x.side") == "gold", F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("x.side") == "pred", F.col("n")).otherwise(0)).alias("called"),
    )
    if labels is not None:
        per = labels.select("label").join(per, "label", "left").fillna(0, ["tp", "support", "called"])
    return per.select(
        *by, "label", over(F.col("tp"), F.col("called")).alias("precision"), over(F.col("tp"), F.col("support")).alias("recall"),
        over(2 * F.col("tp"), F.col("called") + F.col("support")).alias("f1"), "support",
    )


def intent_scores(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """n, accuracy and macro-F1 over the labels seen on either side."""
    by = list(by)
    right = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col("gold") == F.col("pred")).cast("double")).alias("accuracy"))
    macro = per_class_report(rows, by).groupBy(*by).agg(F.avg("f1").alias("macro_f1"))
    return right.join(macro, by) if by else right.join(macro, F.lit(True))


def routing_scores(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """Coverage and harm; rows (gold_action, action)."""
    sent, should = F.col("action") == "auto", F.col("gold_action") == "escalate"
    counts = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(sent).alias("n_auto"), F.count_if(should).alias("n_should"),
        F.count_if(~sent & should).alias("tp"), F.count_if(~sent & ~should).alias("fp"),
        F.count_if(sent & should).alias("fn"), F.count_if(sent & ~should).alias("tn"),
    )
    return counts.select(
        *by, "n", over(F.col("n_auto"), F.col("n")).alias("coverage"), over(F.col("fn"), F.col("n_auto")).alias("false_auto_rate"),
        over(F.col("fn"), F.col("n_should")).alias("escalation_miss_rate"), over(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        over(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), "tp", "fp", "fn", "tn",
    )


def coverage_curve(rows: DataFrame, score: str = "score", steps: int = 40) -> DataFrame:
    """threshold, n_auto, coverage, false_auto_rate at steps + 1 thresholds from 0 to 1: one pass over the rows
    (score, forced, gold_action), counts per bucket, then a running sum over at most steps + 2 buckets."""
    level = F.least(F.floor(F.col(score) * steps), F.lit(steps)).cast("int")
    level = F.when(~F.col("forced") & (F.col(score) >= 0), level).otherwise(-1)
    # floor of a product may fall on the wrong side of a threshold k / steps: set it right by the comparison itself
    level = F.when((level >= 0) & (level < steps) & (F.col(score) >= (level + 1) / steps), level + 1).when((level >= 0) & (F.col(score) < level / steps), level - 1).otherwise(level)
    counts = rows.groupBy(level.alias("level")).agg(F.count("*").alias("c"), F.count_if(F.col("gold_action") == "escalate").alias("bad"))
    grid = rows.sparkSession.range(-1, steps + 1).select(F.col("id").cast("int").alias("level"))
    filled = F.broadcast(grid).join(counts, "level", "left").fillna(0, ["c", "bad"])
    above = Window.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy("level").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summed = filled.select("level", F.sum("c").over(above).alias("n_auto"), F.sum("bad").over(above).alias("bad"), F.sum("c").over(whole).alias("n"))
    return summed.where("level >= 0").select((F.col("level") / steps).alias("threshold"), over(F.col("n_auto"), F.col("n")).alias("coverage"), over(F.col("bad"), F.col("n_auto")).alias("false_auto_rate"), "n_auto")


def best_threshold(curve: DataFrame, budget: float) -> DataFrame:
    """The point of most coverage within the budget, the lowest threshold on ties; no row if there is none."""
    return curve.where((F.col("n_auto") > 0) & (F.col("false_auto_rate") <= budget)).orderBy(F.desc("coverage"), "threshold").limit(1)


def harm_floor(curve: DataFrame) -> DataFrame:
    return curve.where("n_auto > 0").orderBy("false_auto_rate", "threshold").limit(1)


def tune_thresholds(rows: DataFrame, budget: float = 0.10, scores: tuple = (("confidence", 0.9), ("max_similarity", 0.75))) -> DataFrame:
    """score, threshold, budget_feasible, floor: chosen thresholds, or defaults where the budget cannot be met."""
    parts = None
    for name, default in scores:
        curve = coverage_curve(rows, name)
        best, floor = best_threshold(curve, budget).select("threshold"), harm_floor(curve).select(F.col("false_auto_rate").alias("floor"))
        one = rows.sparkSession.range(1).select(F.lit(name).alias("score")).join(best, F.lit(True), "left").join(floor, F.lit(True), "left")
        one = one.select("score", F.coalesce("threshold", F.lit(default)).alias("threshold"), F.col("threshold").isNotNull().alias("budget_feasible"), "floor")
        parts = one if parts is None else parts.unionByName(one)
    return parts


def kappa(rows: DataFrame, by: list[str] = (), weighted: bool = False) -> DataFrame:
    """n, raw_agreement, kappa of two raters (a, b); quadratic weights over the index of the values present if weighted.
    NaN where chance agreement is certain."""
    return kappa_of(rows.groupBy(*by, "a", "b").agg(F.count("*").alias("o")), by, weighted)


def kappa_of(counts: DataFrame, by: list[str] = (), weighted: bool = False) -> DataFrame:
    """The same from counts (o) of pairs, which may be counted in parts."""
    by = list(by)
    cells = counts.groupBy(*by, "a", "b").agg(F.sum("o").alias("o"))
    values = cells.select(*by, F.explode(F.array(F.col("a"), F.col("b"))).alias("v")).distinct()
    index = values.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy("v") if by else Window.orderBy("v")))
    left = cells.groupBy(*by, "a").agg(F.sum("o").alias("na"))
    right = cells.groupBy(*by, "b").agg(F.sum("o").alias("nb"))
    on = (lambda x, y: x.join(y, by)) if by else (lambda x, y: x.join(y, F.lit(True)))
    square = on(left, right)  # of values, not of rows
    square = square.join(index.select(*by, F.col("v").alias("a"), F.col("i").alias("ia")), [*by, "a"]).join(index.select(*by, F.col("v").alias("b"), F.col("i").alias("ib")), [*by, "b"])
    square = square.join(cells, [*by, "a", "b"], "left").fillna(0, ["o"])
    w = F.pow(F.col("ia") - F.col("ib"), 2) if weighted else (F.col("ia") != F.col("ib")).cast("double")
    sums = square.groupBy(*by).agg(
        F.sum("o").alias("n"), F.sum(F.when(F.col("ia") == F.col("ib"), F.col("o")).otherwise(0)).alias("same"),
        F.sum(w * F.col("o")).alias("seen"), F.sum(w * F.col("na") * F.col("nb")).alias("chance"),
    )
    value = F.when(F.col("chance") > 0, 1 - F.col("seen") * F.col("n") / F.col("chance")).otherwise(F.lit(float("nan")))
    return sums.select(*by, "n", (F.col("same") / F.col("n")).alias("raw_agreement"), value.alias("kappa"))


def average_ranks(rows: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """by, the distinct values, c_ (rows that have it) and rank_ (ties share their mean rank), from counts per value."""
    per = rows.groupBy(*by, value).agg(F.count("*").alias("c_"))
    if by:
        below = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        summed = per.withColumn("sum_", F.sum("c_").over(below))
    else:
        summed = running_sum(per, [F.col(value)], "c_", "sum_")
    return summed.select(*by, value, "c_", (F.col("sum_") - (F.col("c_") - 1) / 2).alias("rank_"))


def spearman(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """n, rho, mean_bias (b - a); rho is null for fewer than three rows or a constant series. Ranks come from counts per
    value, so no window holds more than the distinct values of a group."""
    by = list(by)
    ranked = rows
    for c in ("a", "b"):
        ranks = average_ranks(rows, c, by).select(*by, c, F.col("rank_").alias(f"r{c}"))
        ranked = ranked.join(ranks, [*by, c])
    sums = ranked.groupBy(*by).agg(F.count("*").alias("n"), (F.covar_pop("ra", "rb") / F.nullif(F.stddev_pop("ra") * F.stddev_pop("rb"), F.lit(0.0))).alias("rho"), F.avg(F.col("b") - F.col("a")).alias("mean_bias"), F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("b").alias("b0"), F.max("b").alias("b1"))
    fit = (F.col("n") >= 3) & (F.col("a0") < F.col("a1")) & (F.col("b0") < F.col("b1"))
    return sums.select(*by, "n", F.when(fit, F.col("rho")).alias("rho"), "mean_bias")


def per_stratum_scores(rows: DataFrame, least: int = 3) -> DataFrame:
    """Accuracy and routing per system and stratum of at least ``least`` rows."""
    by = ["system", "stratum"]
    right = rows.groupBy(*by).agg(F.avg((F.col("gold") == F.col("pred")).cast("double")).alias("accuracy"))
    return routing_scores(rows, by).join(right, by).where(F.col("n") >= least)


def rule_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("system", "triggered_rule").agg(F.count("*").alias("n"), F.count_if(F.col("action") == "escalate").alias("n_escalated"))


def degenerate_routing_flag(rows: DataFrame) -> DataFrame:
    return rows.groupBy("system").agg(F.bool_and(F.col("action") == "escalate").alias("escalates_everything"))


def majority_class(rows: DataFrame, label: str, position: str) -> DataFrame:
    """The most common label, the first seen on ties; ``other`` without rows."""
    best = rows.groupBy(label).agg(F.count("*").alias("n"), F.min(position).alias("first")).orderBy(F.desc("n"), "first").limit(1)
    return best.select(F.col(label).alias("label")).agg(F.coalesce(F.max("label"), F.lit("other")).alias("label"))
