"""Readers and writers of manifests, samples, findings, scores and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE = (
    "sample_id string, file_path string, function_name string, start_line int, end_line int, label int, vulnerability_type string, source_code string, repo_url string, commit_id string, target_commit string, cve_id string,"
    " cvss_score double, fixed_code string, diff_with_context string, sample_subtype string"
)
MANIFEST = f"project string, git_source struct<git_url:string,ref:string>, local_source struct<root_path:string>, samples array<struct<{', '.join(': '.join(x.split()) for x in SAMPLE.split(', '))}>>"
FINDINGS = "results array<struct<path:string,start:struct<line:int>,end:struct<line:int>,extra:struct<severity:string,message:string>>>"
SCORES = "sample_id string, project string, file_path string, function_name string, label int, severity string, severity_weight double, slm_score double, vulnerability_type string, provenance struct<project:string,git_url:string,requested_ref:string,resolved_commit_sha:string,cloned_at_utc:string>"


class InvalidManifest(ValueError):
    """A manifest whose rows break the rules; the message lists some of them."""


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The samples of a JSON list of projects; projects without samples drop out. Raises InvalidManifest."""
    projects = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    rows = projects.select("project", F.when(F.col("git_source").isNotNull(), "git").otherwise("local").alias("source_kind"), (F.col("git_source").isNull() == F.col("local_source").isNull()).alias("_bad"), F.explode("samples").alias("s"))
    rows = rows.select("project", "source_kind", "_bad", "s.*")
    needed = ("sample_id", "file_path", "function_name", "start_line", "end_line", "label")
    broken = F.col("_bad") | ~F.col("label").isin(0, 1) | (F.col("start_line") > F.col("end_line"))
    for c in needed:
        broken |= F.col(c).isNull()
    problems = [r.sample_id for r in rows.filter(broken).select("sample_id").limit(20).collect()]
    problems += [r.sample_id for r in rows.groupBy("sample_id").count().filter("count > 1").limit(20).collect()]
    if problems:
        raise InvalidManifest(f"bad samples, for example {problems}")
    return rows.drop("_bad")


def write_manifest(samples: DataFrame, path: str, project: str = "project") -> None:
    """One JSON object per project, a line each."""
    inner = [c for c in samples.columns if c not in (project, "source_kind")]
    samples.groupBy(project).agg(F.collect_list(F.struct(*inner)).alias("samples")).write.mode("overwrite").json(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """(text, label) of a JSON-lines file; other fields are not read."""
    return spark.read.schema("text string, label int").json(path)


def write_samples(samples: DataFrame, path: str) -> None:
    samples.write.mode("overwrite").json(path)


def read_findings(spark: SparkSession, path: str, default_severity: str = "WARNING") -> DataFrame:
    """(file, start, end, severity, ord) of a findings report, in its order."""
    rows = spark.read.schema(FINDINGS).option("multiLine", True).json(path).select(F.posexplode("results").alias("ord", "r"))
    return rows.select(F.regexp_replace("r.path", r"\\", "/").alias("file"), F.col("r.start.line").alias("start"), F.col("r.end.line").alias("end"), F.coalesce("r.extra.severity", F.lit(default_severity)).alias("severity"), "ord")


def read_sources(spark: SparkSession, root: str, excluded: tuple[str, ...] = ("tests", "workspace_storage", "venv"), suffix: str = "*.py") -> DataFrame:
    """(file, source, sha256) of the files below `root`, by path relative to it, without excluded folders."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=suffix)
    rows = files.select(F.regexp_replace(F.col("_metadata.file_path"), "^.*" + root.strip("/").replace(".", r"\.") + "/", "").alias("file"), F.col("value").alias("source"))
    for folder in excluded:
        rows = rows.filter(~F.startswith("file", F.lit(folder + "/")))
    return rows.withColumn("sha256", F.sha2("source", 256))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))


def cached_scores(spark: SparkSession, path: str, compute: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at `path` if it is whole, else what `compute` gives, written there first."""
    if force or not _exists(spark, path):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def record_json(rows: DataFrame) -> DataFrame:
    """Each row as one JSON string."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def from_record_json(rows: DataFrame, schema: str) -> DataFrame:
    return rows.select(F.from_json("value", schema).alias("r")).select("r.*")


def append_embeddings(store_path: str, rows: DataFrame, keys: tuple[str, ...] = ("file_hash", "function_name", "start_line")) -> None:
    """Append the rows whose keys the store lacks."""
    from tamis.operators.retrieval import new_rows

    spark = rows.sparkSession
    fresh = new_rows(spark.read.parquet(store_path), rows, list(keys)) if _exists(spark, store_path) else rows.dropDuplicates(list(keys))
    fresh.write.mode("append").parquet(store_path)


def write_report(report: DataFrame, path: str) -> None:
    """Nested findings, a JSON object a line."""
    report.write.mode("overwrite").json(path)


def read_first(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first whole Parquet table of `paths`, local copies before remote ones; FileNotFoundError if there is none."""
    for path in paths:
        if _exists(spark, path):
            return spark.read.parquet(path)
    raise FileNotFoundError(f"no table at {paths}")


# Folder names that are vulnerability types, and parts of a path that mark label 1.
VULNERABILITY_TYPES = ("sql", "xss", "command", "xsrf", "remote_code_execution", "path_disclosure", "open_redirect")
UNSAFE_PARTS = ("vul", "unsafe")
# End of fixed values.


def read_labelled_files(spark: SparkSession, root: str) -> DataFrame:
    """(file, raw_lines, label, type), one row per *.py file below `root`, or per *.txt file if there is none: type from
    the parent folder's name, label from the whole path, both repeated for each line."""
    from tamis.functions.text import lines

    def found(pattern: str) -> DataFrame:
        files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
        return files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))

    files = found("*.py")
    if files.isEmpty():
        files = found("*.txt")
    parent = F.lower(F.element_at(F.split("file", "/"), -2))
    kind = F.when(parent.isin(*VULNERABILITY_TYPES), parent).otherwise("unknown")
    unsafe = F.lit(False)
    for part in UNSAFE_PARTS:
        unsafe |= F.lower("file").contains(part)
    rows = files.select("file", lines(F.col("text")).alias("raw_lines"), unsafe.cast("int").alias("y"), kind.alias("kind"))
    return rows.select("file", "raw_lines", F.transform("raw_lines", lambda _: F.col("y")).alias("label"), F.transform("raw_lines", lambda _: F.col("kind")).alias("type"))


def write_evaluation(summary: DataFrame, findings: DataFrame, folder: str) -> None:
    """summary (a row per variant, the metrics as columns) as JSON and as a Markdown table, findings as JSON lines."""
    spark = summary.sparkSession
    summary.coalesce(1).write.mode("overwrite").json(f"{folder}/summary")
    findings.write.mode("overwrite").json(f"{folder}/detailed_findings")
    rows = summary.collect()  # a row per variant
    table = [summary.columns, ["-"] * len(summary.columns), *([str(v) for v in r] for r in rows)]
    spark.createDataFrame([("\n".join("| " + " | ".join(r) + " |" for r in table),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/report")
