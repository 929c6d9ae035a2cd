"""The gate over a stream of scored samples, and risk by time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.functions import gates


def gated(stream: DataFrame, severity: str = "severity", score: str = "slm_score", **params) -> DataFrame:
    """Each row with its risk and whether it escalates; stateless."""
    sev = gates.severity_weight(F.col(severity))
    return stream.withColumns({"risk": F.round(gates.risk(sev, F.col(score)), 4), "escalate": gates.linear_gate(sev, F.col(score), **params)})


def escalations_by_window(stream: DataFrame, time: str = "ts", length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows and escalations per window; a window closes when the watermark has passed it."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, length).alias("w"))
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("escalate").cast("long")).alias("escalated")).select(F.col("w.start").alias("start"), "n", "escalated")
