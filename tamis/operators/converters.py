"""Raw corpora to samples: field resolution, line labels, manifests, fixed pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions import code
from tamis.functions import text as T

#: Where a fix commit may stand, in order.
COMMIT_COLUMNS = ("hash", "commit_id", "commit_hash", "commit_sha")
def present(*columns: str) -> list[Column]:
    """The columns, stripped; blank is null."""
    return [F.nullif(T.strip(F.col(c)), F.lit("")) for c in columns]


def fix_samples(rows: DataFrame, emit_fixed: bool = False) -> DataFrame:
    """Samples of the Python rows that have vulnerable code, fixed code and a repository, their fields resolved; a
    version 3 score of 0.0 wins over version 2. With `emit_fixed` each vulnerable sample (label 1, to be read at the
    fix commit's parent) has a fixed twin (label 0, read at the fix commit)."""
    language = F.lower(F.coalesce(*present("language", "lang"), F.lit("")))
    (url,), (fixed,), (diff,) = present("repo_url"), present("fixed_code"), present("diff_with_context")
    project = F.regexp_replace(F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1), r"\.git", "")
    kept = rows.filter(((language == "") | language.isin("python", "py")) & present("vulnerable_code")[0].isNotNull() & fixed.isNotNull() & url.isNotNull())
    commit = F.coalesce(*present(*COMMIT_COLUMNS), F.lit("unknown_commit"))
    twin = lambda subtype, label, code_, target: F.struct(F.lit(subtype).alias("sample_subtype"), F.lit(label).alias("label"), code_.alias("source_code"), target.alias("target_commit"))
    twins = [twin("vulnerable", 1, F.col("vulnerable_code"), F.lit(None).cast("string"))] + ([twin("fixed", 0, fixed, commit)] if emit_fixed else [])
    kept = kept.select(
        "id", project.alias("project"), commit.alias("commit_id"), F.coalesce(*present("cve_id"), F.lit("unknown_cve")).alias("cve_id"), T.strip(F.coalesce("cwe_id", F.lit("unknown"))).alias("vulnerability_type"),
        F.coalesce("cvss3_base_score", "cvss2_base_score", F.lit(0.0)).alias("cvss_score"), F.coalesce(diff, F.lit("")).alias("diff_with_context"), "fixed_code", F.explode(F.array(*twins)).alias("t"),
    )
    return kept.select("*", "t.*").drop("t")


def fix_samples_sql(rows: str) -> str:
    """The same with twins, for DuckDB; `rows` is a query."""
    from tamis.plans.dialect import strip

    blank = lambda c: f"nullif({strip(c)}, '')"
    return f"""WITH r AS ({rows}),
x AS (SELECT *, lower(coalesce({blank('language')}, {blank('lang')}, '')) AS l, coalesce({', '.join(map(blank, COMMIT_COLUMNS))}, 'unknown_commit') AS c FROM r
  WHERE {blank('vulnerable_code')} IS NOT NULL AND {blank('fixed_code')} IS NOT NULL AND {blank('repo_url')} IS NOT NULL)
SELECT id, replace(string_split(rtrim({strip('repo_url')}, '/'), '/')[-1], '.git', '') AS project, c AS commit_id, coalesce({blank('cve_id')}, 'unknown_cve') AS cve_id, {strip("coalesce(cwe_id, 'unknown')")} AS vulnerability_type,
  coalesce(cvss3_base_score, cvss2_base_score, 0)::DOUBLE AS cvss_score, coalesce({blank('diff_with_context')}, '') AS diff_with_context, fixed_code, t.s AS sample_subtype, t.y AS label,
  CASE t.y WHEN 1 THEN vulnerable_code ELSE {blank('fixed_code')} END AS source_code, CASE t.y WHEN 1 THEN NULL ELSE c END AS target_commit
FROM x, (VALUES ('vulnerable', 1), ('fixed', 0)) t(s, y) WHERE l IN ('', 'python', 'py')"""


def line_label_samples(rows: DataFrame, id_col: str) -> DataFrame:
    """Rows (raw_lines, lines, label, type per line): label 1 if any line is, the most frequent type but "0" (the first
    on ties), the stripped source. Rows without source go."""
    source = T.strip(F.array_join(F.coalesce("raw_lines", "lines", F.expr("cast(array() as array<string>)")), "\n"))
    kinds = F.filter("type", lambda t: (t != "") & (t != "0"))
    # counts as -count, so that the least struct is the most frequent and, on ties, the first kind
    tallies = F.transform(F.array_distinct(kinds), lambda k: F.struct((-F.size(F.filter(kinds, lambda t: t == k))).alias("n"), F.array_position(kinds, k).alias("at"), k.alias("kind")))
    kind = F.coalesce(F.array_min(tallies)["kind"], F.lit("unknown"))
    label = F.exists("label", lambda x: x == 1).cast("int")
    return rows.select(id_col, F.coalesce(label, F.lit(0)).alias("label"), kind.alias("vulnerability_type"), source.alias("source_code")).filter("source_code <> ''")


def manifest_violations(rows: DataFrame) -> DataFrame:
    """(sample_id, problem): missing fields, bad labels, reversed lines, no or two sources, repeated ids."""
    tests = {
        "missing field": F.col("sample_id").isNull() | F.col("file_path").isNull(), "label": ~F.col("label").isin(0, 1), "lines": F.col("start_line") > F.col("end_line"),
        "source": F.col("git_url").isNull() == F.col("root_path").isNull(),
    }
    found = rows.select("sample_id", F.explode(F.filter(F.array(*(F.when(t, F.lit(n)) for n, t in tests.items())), lambda x: x.isNotNull())).alias("problem"))
    repeated = rows.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("sample_id", F.lit("repeated id").alias("problem"))
    return found.unionByName(repeated)


def manifest_violations_sql(rows: str) -> str:
    return f"""WITH r AS ({rows})
SELECT sample_id, 'missing field' AS problem FROM r WHERE sample_id IS NULL OR file_path IS NULL UNION ALL SELECT sample_id, 'label' FROM r WHERE label NOT IN (0, 1)
UNION ALL SELECT sample_id, 'lines' FROM r WHERE start_line > end_line UNION ALL SELECT sample_id, 'source' FROM r WHERE (git_url IS NULL) = (root_path IS NULL)
UNION ALL SELECT sample_id, 'repeated id' FROM r GROUP BY sample_id HAVING count(*) > 1"""


def benign_samples(rows: DataFrame) -> DataFrame:
    """Safe rows in the shape of samples, with ids made from their content."""
    return rows.select(
        F.concat(F.lit("benign_"), F.substring(F.sha2(F.concat(F.lit("benign|"), F.col("sample_id").cast("string")), 256), 1, 16)).alias("sample_id"), F.concat(F.lit("benign::"), "project").alias("project"),
        F.lit(0).alias("label"), F.lit("none").alias("vulnerability_type"), F.lit("benign_control").alias("sample_subtype"), F.lit(1).alias("start_line"),
    )


def commit_seed(commit: Column, seed: int) -> Column:
    return (F.lit(seed) + F.conv(F.substring(F.md5(commit), 1, 8), 16, 10).cast("long")).bitwiseAND(F.lit(2147483647))


def pair_changes(pairs: DataFrame) -> DataFrame:
    """(id, ratio, trivial, substantial) of (id, vuln, fixed)."""
    return pairs.select("id", code.change(F.col("vuln"), F.col("fixed")).alias("c")).select("id", F.round("c.ratio", 6).alias("ratio"), F.col("c.trivial").alias("trivial"), (F.col("c.ratio") > 0.5).alias("substantial"))


def pair_report(rows: DataFrame, ratio: str) -> DataFrame:
    """Shares and the upper median, which is the row in the middle, found by rank."""
    n = rows.count()
    median = rows.orderBy(ratio).offset(n // 2).limit(1).first()
    return rows.agg(
        F.count(F.lit(1)).alias("pairs"), F.round(F.avg((F.col(ratio) == 0).cast("double")), 6).alias("trivial_share"), F.round(F.avg((F.col(ratio) > 0.5).cast("double")), 6).alias("substantial_share"),
        F.round(F.avg(ratio), 6).alias("mean_ratio"), F.lit(median[ratio] if median else None).cast("double").alias("median_ratio"),
    )


BUCKETS = (("0-10%", 0.1), ("10-25%", 0.25), ("25-50%", 0.5), ("50-75%", 0.75), ("75-100%", None))


def ratio_bucket(ratio: Column) -> Column:
    out = None
    for name, below in BUCKETS[:-1]:
        out = F.when(ratio < below, name) if out is None else out.when(ratio < below, name)
    return out.otherwise(BUCKETS[-1][0])


def pair_histogram(rows: DataFrame, ratio: str) -> DataFrame:
    """Rows per bucket, empty ones too."""
    counts = rows.groupBy(ratio_bucket(F.col(ratio)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    every = rows.sparkSession.createDataFrame([(n,) for n, _ in BUCKETS], "bucket string")
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
