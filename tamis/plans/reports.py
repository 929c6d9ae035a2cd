"""Lookups, matches and nested scores of the triage report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions import text as T
from tamis.operators import retrieval, similarity
from tamis.plans import generated
from tamis.plans.curation import labelled
from tamis.plans.samples import table
from tamis.plans.triage import chunk_oracle, scored_chunks


def store_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first stored document of each (file, function) asked for, or none: sources as files, languages as functions."""
    store = table(spark, sf_dir, "documents").select(F.col("source").alias("file"), F.col("lang").alias("function"), "doc_id")
    asked = store.select("file", F.explode(F.array(F.col("function"), F.lit("none"))).alias("function")).distinct()
    found = retrieval.first_match(store, asked, ["file", "function"], "doc_id")
    return found.select("file", "function", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")).alias("found"))


def result_case_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each case (a file name with its folder) the first finding whose path ends with it; pages as findings."""
    findings = table(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), F.regexp_replace("url", "^[a-z]+://[^/]*", "").alias("path"))
    cases = findings.select(F.regexp_extract("path", "[^/]*/[^/]+$", 0).alias("expected")).filter("expected <> ''").distinct()
    return retrieval.match_by_suffix(cases, findings)


def chunk_score_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's score and its chunks with their probability: metadata and scores meet by key, not by position."""
    chunks = scored_chunks(spark, sf_dir)
    meta, scores = chunks.select("doc_id", "chunk_index", "start_line", "end_line"), chunks.select("doc_id", "chunk_index", "prob")
    nested = retrieval.nested_scores(meta, scores, ["doc_id"])
    one = lambda c: F.concat_ws(":", c["chunk_index"].cast("string"), c["start_line"].cast("string"), c["end_line"].cast("string"), F.round(c["prob"] * 10000).cast("long").cast("string"))
    return nested.select("doc_id", "score", F.array_join(F.transform("chunks", one), ",").alias("chunks"))


def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest run of each project: orders as runs, customers as projects; ties go to the greater name."""
    runs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("run"), F.col("o_orderdate").alias("modified"))
    return retrieval.latest(runs, ["project"], "modified", "run")


def triage_function_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The function that a finding's source begins with; async ones too."""
    return generated.frame(spark, sf_dir, "sources").select("file", T.first_def_name(F.col("source")).alias("function_name"))


def max_token_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each even document, the greatest token similarity above 0.75 to an odd one, else 0."""
    d = labelled(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", "label")
    best = similarity.max_similarity(d.filter("label = 0").drop("label"), d.filter("label = 1").drop("label"), 0.75)
    return best.select(F.col("id").alias("doc_id"), F.round("similarity", 6).alias("similarity"))


QUERIES = {f.__name__: f for f in (store_lookup, result_case_match, chunk_score_struct, latest_run, triage_function_names, max_token_similarity)}

ORACLES = {
    "store_lookup": """WITH a AS (SELECT DISTINCT source AS file, unnest([lang, 'none']) AS function FROM documents)
SELECT a.file, a.function, coalesce(CAST(min(d.doc_id) AS VARCHAR), 'none') AS found FROM a LEFT JOIN documents d ON d.source = a.file AND d.lang = a.function GROUP BY ALL""",
    "result_case_match": """WITH f AS (SELECT page_id AS ord, regexp_replace(url, '^[a-z]+://[^/]*', '') AS path FROM pages),
c AS (SELECT DISTINCT regexp_extract(path, '[^/]*/[^/]+$', 0) AS expected FROM f WHERE regexp_extract(path, '[^/]*/[^/]+$', 0) <> '')
SELECT expected, min(ord) AS ord, min_by(path, ord) AS path FROM c JOIN f ON ends_with(path, expected) GROUP BY expected""",
    "chunk_score_struct": f"""WITH {chunk_oracle(8, 2)}, scored AS (SELECT *, CAST((doc_id * 31 + length(text) * 7919) % 10000 AS DOUBLE) / 10000 AS prob FROM ch)
SELECT doc_id, max(prob) AS score, string_agg(chunk_index || ':' || start_line || ':' || end_line || ':' || CAST(round(prob * 10000) AS BIGINT), ',' ORDER BY chunk_index) AS chunks FROM scored GROUP BY doc_id""",
    "latest_run": "SELECT o_custkey AS project, max(o_orderdate) AS modified, max(o_orderkey) AS run FROM (SELECT *, max(o_orderdate) OVER (PARTITION BY o_custkey) AS m FROM orders) WHERE o_orderdate = m GROUP BY o_custkey",
    "triage_function_names": rf"""WITH f AS ({generated.sql('sources')}), h AS (SELECT file, regexp_extract(source, '(?:^|\n)\s*(?:async )?def\s+([^\s(]*)', 1) AS name FROM f)
SELECT file, CASE WHEN name = '' THEN 'unknown_function' ELSE name END AS function_name FROM h""",
}
