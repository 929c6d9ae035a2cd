"""Confusion counts, gate metrics and ranking curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.operators.checkpoint import checkpointed

COUNTS = ("tp", "fp", "fn", "tn")


def confusion(prediction: Column, label: Column) -> list[Column]:
    hit = label == 1
    cells = (prediction & hit, prediction & ~hit, ~prediction & hit, ~prediction & ~hit)
    return [F.coalesce(F.sum(F.when(c, F.lit(1)).otherwise(F.lit(0))), F.lit(0)).cast("long").alias(n) for n, c in zip(COUNTS, cells, strict=True)]


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def with_metrics(counts: DataFrame, beta: float = 2.0, cost_ratio: float = 0.02) -> DataFrame:
    """`counts` (tp, fp, fn, tn) and the rates, to four decimals; 0/0 is 0."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in COUNTS)
    total, b2 = tp + fp + fn + tn, float(beta) ** 2
    out = counts.withColumns({"_p": _ratio(tp, tp + fp), "_r": _ratio(tp, tp + fn), "_e": _ratio(tp + fp, total)})
    p, r = F.col("_p"), F.col("_r")
    trr = F.round(1.0 - F.col("_e"), 4)
    return out.withColumns({
        "precision": F.round(p, 4), "recall": F.round(r, 4), "specificity": F.round(_ratio(tn, tn + fp), 4), "accuracy": F.round(_ratio(tp + tn, total), 4),
        "f1": F.round(_ratio(2 * p * r, p + r), 4), f"f{beta:g}": F.round(_ratio((1 + b2) * p * r, b2 * p + r), 4), "escalation_rate": F.round(F.col("_e"), 4),
        "token_reduction_rate": trr, "cost_savings_ratio": F.round(trr * (1.0 - max(0.0, min(1.0, cost_ratio))), 4), "total_samples": total.cast("long"),
    }).drop("_p", "_r", "_e")


def gate_metrics(df: DataFrame, prediction: Column, label: Column, keys: list[str] | None = None, **options) -> DataFrame:
    return with_metrics((df.groupBy(*keys) if keys else df).agg(*confusion(prediction, label)), **options)


#: Distinct scores that one ordered window is meant to see, and how many windows there are at most.
SCORES_PER_RANGE = 100_000
MOST_RANGES = 1_000


def ranking(df: DataFrame, score: str, label: str, per_range: int = SCORES_PER_RANGE) -> DataFrame:
    """Per distinct score, from the highest: positives and negatives at it and up to it, and the totals.

    Rows are summed per score first; distinct scores are then cut into ranges by quantiles, each range is summed in
    order on its own, and the sums of the ranges above it (a row per range) are added. Null scores come last."""
    by_score = df.groupBy(F.col(score).alias("score")).agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) != 1).cast("long")).alias("n"))
    by_score = checkpointed(df.sparkSession)(by_score)
    ranges = min(MOST_RANGES, -(-by_score.count() // per_range))
    part = F.lit(0)
    if ranges > 1:
        cuts = by_score.agg(F.percentile_approx("score", [k / ranges for k in range(1, ranges)], 10_000)).first()[0] or []
        part = F.when(F.col("score").isNull(), ranges).otherwise(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c > F.col("score"))))
    placed = by_score.withColumn("part", part)
    sums = placed.groupBy("part").agg(F.sum("p").alias("sum_p"), F.sum("n").alias("sum_n"))
    above = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.select("part", *(F.coalesce(F.sum(f"sum_{c}").over(above), F.lit(0)).alias(f"above_{c}") for c in "pn"), *(F.sum(f"sum_{c}").over(whole).alias(f"all_{c}") for c in "pn"))
    upto = Window.partitionBy("part").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(F.broadcast(sums), "part").select("score", "p", "n", *((F.sum(c).over(upto) + F.col(f"above_{c}")).alias(f"cum_{c}") for c in "pn"), "all_p", "all_n")


def roc_points(df: DataFrame, score: str, label: str) -> DataFrame:
    r = ranking(df, score, label)
    return r.select("score", F.round(F.col("cum_n") / F.col("all_n"), 6).alias("fpr"), F.round(F.col("cum_p") / F.col("all_p"), 6).alias("tpr"))


def pr_points(df: DataFrame, score: str, label: str) -> DataFrame:
    r = ranking(df, score, label)
    return r.select("score", F.round(F.col("cum_p") / (F.col("cum_p") + F.col("cum_n")), 6).alias("precision"), F.round(F.col("cum_p") / F.col("all_p"), 6).alias("recall"))


def ranking_scores(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: roc_auc (ties count half) and average precision; null where a class is missing."""
    r = ranking(df, score, label)
    wins = F.sum(F.col("p") * (F.col("all_n") - F.col("cum_n")) + F.col("p") * F.col("n") / 2)
    return r.agg(
        F.round(wins / (F.max("all_p") * F.max("all_n")), 6).alias("roc_auc"),
        F.round(F.sum(F.col("p") / F.col("all_p") * F.col("cum_p") / (F.col("cum_p") + F.col("cum_n"))), 6).alias("average_precision"),
    )


def calibration(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """Equal bins of [0, 1] that have rows: mean score, share of label 1, rows."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.round(F.avg(score), 6).alias("mean_score"), F.round(F.avg((F.col(label) == 1).cast("double")), 6).alias("positive_share"), F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, score: str, bins: int = 15) -> DataFrame:
    """Rows per equal bin between the least and the greatest score, empty bins too."""
    lo, hi = df.agg(F.min(score), F.max(score)).first()
    if lo is None:
        lo = hi = 0.0
    width = (hi - lo) / bins or 1.0
    b = F.least(F.floor((F.col(score) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
