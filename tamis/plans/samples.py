"""The sample relation of the queries: documents with labels, and synthetic severity and score signals.

The tables carry no findings, so that severity goes by doc_id % 4 and the model score by a multiple of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions.gates import severity_weight

SEVERITIES = ("NONE", "INFO", "WARNING", "ERROR")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, project, cwe, label, severity, sev, slm); label 1 is low quality."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    severity = F.element_at(F.array(*map(F.lit, SEVERITIES)), (F.col("doc_id") % 4 + 1).cast("int"))
    joined = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return joined.select(
        F.col("doc_id").alias("sample_id"), F.col("source").alias("project"), F.col("lang").alias("cwe"), (F.col("quality") == 0).cast("int").alias("label"),
        severity.alias("severity"), severity_weight(severity).alias("sev"), ((F.col("doc_id") * 7919 % 1000).cast("double") / 1000).alias("slm"),
    )


#: The same for DuckDB, as a relation named s.
S = """s AS (SELECT d.doc_id AS sample_id, d.source AS project, d.lang AS cwe, CASE WHEN l.quality = 0 THEN 1 ELSE 0 END AS label,
  CASE d.doc_id % 4 WHEN 0 THEN 'NONE' WHEN 1 THEN 'INFO' WHEN 2 THEN 'WARNING' ELSE 'ERROR' END AS severity,
  CAST(CASE d.doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 0.3 WHEN 2 THEN 0.7 ELSE 1 END AS DOUBLE) AS sev, CAST(d.doc_id * 7919 % 1000 AS DOUBLE) / 1000 AS slm
  FROM documents d JOIN labels l USING (doc_id))"""


def metrics_sql(source: str, keys: str = "", prediction: str = "pred", label: str = "label") -> str:
    """DuckDB metrics over `source`, a relation with a prediction and a label."""
    by = f"GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    ratio = lambda a, b: f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0 END"
    return f"""SELECT {lead}tp, fp, fn, tn, round(p, 4) AS precision, round(r, 4) AS recall, round({ratio('tn', '(tn + fp)')}, 4) AS specificity,
  round({ratio('(tp + tn)', 'n')}, 4) AS accuracy, round({ratio('2 * p * r', '(p + r)')}, 4) AS f1, round({ratio('5 * p * r', '(4 * p + r)')}, 4) AS f2,
  round(e, 4) AS escalation_rate, round(1 - e, 4) AS token_reduction_rate, round(round(1 - e, 4) * CAST(0.98 AS DOUBLE), 4) AS cost_savings_ratio, n AS total_samples
FROM (SELECT *, {ratio('tp', '(tp + fp)')} AS p, {ratio('tp', '(tp + fn)')} AS r, {ratio('(tp + fp)', 'n')} AS e
  FROM (SELECT {lead}count(*) FILTER ({prediction} AND {label} = 1) AS tp, count(*) FILTER ({prediction} AND {label} <> 1) AS fp,
    count(*) FILTER (NOT {prediction} AND {label} = 1) AS fn, count(*) FILTER (NOT {prediction} AND {label} <> 1) AS tn, count(*) AS n FROM {source} {by}))"""
