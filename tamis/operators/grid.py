"""Grid search over gate weights and thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.functions.gates import risk
from tamis.operators.metrics import with_metrics


def grid_points(steps: int = 21) -> list[tuple[float, float, float]]:
    axis = [round(k / (steps - 1), 4) for k in range(steps)]
    return [(w, round(1.0 - w, 4), t) for w in axis for t in axis]


def grid_search(df: DataFrame, sev: str, slm: str, label: str, points: list[tuple[float, float, float]] | None = None, beta: float = 2.0) -> DataFrame:
    """Metrics of every grid point. Rows are first counted per distinct (severity, score, label); each count then
    explodes over the grid, which stays a literal, and a partial aggregate folds it at once."""
    counted = df.groupBy(F.col(sev).alias("sev"), F.col(slm).alias("slm"), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    grid = F.array(*(F.struct(F.lit(w).alias("weight_static"), F.lit(v).alias("weight_slm"), F.lit(t).alias("threshold")) for w, v, t in points or grid_points()))
    rows = counted.select("*", F.explode(grid).alias("g")).select("sev", "slm", "label", "n", "g.*")
    up = risk(F.col("sev"), F.col("slm"), F.col("weight_static"), F.col("weight_slm")) >= F.col("threshold")
    hit = F.col("label") == 1
    cells = {"tp": up & hit, "fp": up & ~hit, "fn": ~up & hit, "tn": ~up & ~hit}
    counts = rows.groupBy("weight_static", "weight_slm", "threshold").agg(*(F.sum(F.when(c, F.col("n")).otherwise(0)).alias(k) for k, c in cells.items()))
    return with_metrics(counts, beta=beta)


def best_point(grid: DataFrame, metric: str = "f2") -> DataFrame:
    """The first point by metric, recall, least escalation, least weight and threshold."""
    return grid.orderBy(F.col(metric).desc(), F.col("recall").desc(), F.col("escalation_rate"), F.col("weight_static"), F.col("threshold")).limit(1)


