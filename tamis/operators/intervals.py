"""Joins of ranges within a file. Ranges are cut into bins, so that a file with many ranges is many join keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN = 64


def bins(start: Column, end: Column, size: int = BIN) -> Column:
    return F.explode(F.sequence(F.floor(start / size), F.floor(F.greatest(start, end) / size)))


def strongest_overlap(samples: DataFrame, findings: DataFrame, default: str = "NONE") -> DataFrame:
    """Samples (sample_id, file, start, end) and the severity of the overlapping finding (file, start, end, severity,
    weight, ord) of the greatest weight, the first on ties; `default` where none overlaps."""
    left = samples.select("*", bins(F.col("start"), F.col("end")).alias("_bin"))
    right = findings.select("file", F.col("start").alias("f_start"), F.col("end").alias("f_end"), "severity", "weight", "ord", bins(F.col("start"), F.col("end")).alias("_bin"))
    hit = left.join(right, ["file", "_bin"]).filter((F.col("f_start") <= F.col("end")) & (F.col("f_end") >= F.col("start")))
    best = hit.groupBy("sample_id").agg(F.max_by("severity", F.struct("weight", (-F.col("ord")).alias("o"))).alias("severity"))
    return samples.join(best, "sample_id", "left").withColumn("severity", F.coalesce("severity", F.lit(default)))


def ranges_with_points(ranges: DataFrame, points: DataFrame) -> DataFrame:
    """Ranges (file, start, end, ...) that hold at least one point (file, at)."""
    left = ranges.withColumn("_key", F.monotonically_increasing_id()).select("*", bins(F.col("start"), F.col("end")).alias("_bin"))
    right = points.select("file", "at", F.floor(F.col("at") / BIN).alias("_bin")).distinct()
    inside = (left["file"] == right["file"]) & (left["_bin"] == right["_bin"]) & (right["at"] >= left["start"]) & (right["at"] <= left["end"])
    return left.join(right, inside, "left_semi").dropDuplicates([*ranges.columns]).select(*ranges.columns)
