"""Removal of contradictions and repeats from labelled texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions.text import let, normalise


def contradictions(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """(norm) of the normalised, non-empty texts that carry both labels."""
    return df.select(normalise(F.col(text)).alias("norm"), label).filter("norm <> ''").groupBy("norm").agg(F.min(label).alias("lo"), F.max(label).alias("hi")).filter("lo <> hi").select("norm")


def drop_contradictory(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """The rows whose normalised text has one label only, or is empty. Digests are dealt out instead of texts."""
    keyed = df.withColumn("norm", let(normalise(F.col(text)), lambda x: F.when(x != "", F.sha2(x, 256)).otherwise("")))
    mixed = keyed.filter("norm <> ''").groupBy("norm").agg(F.min(label).alias("lo"), F.max(label).alias("hi")).filter("lo <> hi").select("norm")
    return keyed.join(mixed, "norm", "left_anti").drop("norm")


def first_wins(df: DataFrame, order: str, text: str = "text", label: str = "label") -> DataFrame:
    """Each row's fate: kept (the first of its normalised text), duplicate, or contradiction with the first."""
    keyed = df.withColumn("norm", normalise(F.col(text)))
    first = keyed.groupBy("norm").agg(F.min(F.struct(F.col(order).alias("at"), F.col(label).alias("first_label"))).alias("f"))
    fate = F.when(F.col(order) == F.col("f.at"), "kept").when(F.col(label) == F.col("f.first_label"), "duplicate").otherwise("contradiction")
    return keyed.join(first, "norm").withColumn("fate", fate).drop("norm", "f")


def greedy_pair_dedup(df: DataFrame, order: str, first: str, second: str, checkpoint) -> DataFrame:
    """Rows of which neither text was seen among the kept rows before it, as a scan in `order` would keep them.

    Rounds instead of a scan: a row that is the first undecided one for both of its texts is kept, and the rows that
    share a text with a kept row go. `checkpoint` cuts the lineage between rounds."""
    norms = df.select(F.col(order).alias("at"), F.explode(F.array_distinct(F.array(normalise(F.col(first)), normalise(F.col(second))))).alias("norm"))
    undecided, kept = checkpoint(norms), None
    while not undecided.isEmpty():
        lead = undecided.groupBy("norm").agg(F.min("at").alias("lead"))
        now = undecided.join(lead, "norm").groupBy("at").agg(F.min((F.col("at") == F.col("lead")).cast("int")).alias("ok")).filter("ok = 1").select("at")
        now = checkpoint(now)
        kept = now if kept is None else kept.unionByName(now)
        gone = undecided.join(now, "at", "left_semi").select("norm").distinct()
        losers = undecided.join(gone, "norm", "left_semi").select("at").distinct()
        undecided = checkpoint(undecided.join(losers, "at", "left_anti"))
    return df.join(kept, df[order] == kept["at"], "left_semi") if kept is not None else df.limit(0)


def last_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).filter("_r = 1").drop("_r")
