"""Corpus conversion and curation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamis.functions import text as T
from tamis.operators import converters, curation, similarity
from tamis.operators.checkpoint import checkpointed
from tamis.plans import dialect as D
from tamis.plans import generated
from tamis.plans.samples import S, samples, table


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a synthetic label, which equal texts may contradict."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "text", "lang", "source", (F.col("doc_id") % 2).cast("int").alias("label"))


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.normalise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(n).alias("norm_md5"), F.length(n).alias("norm_chars"), F.size(T.lines(F.col("text"))).alias("n_lines"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


def signal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", T.signal_lines(F.col("text")).alias("signal"))
    return d.withColumn("kept", F.col("signal") >= 2)


def noise_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = generated.frame(spark, sf_dir, "paths")
    return rows.select("id", T.is_noise_path(F.col("path")).alias("noise"))


def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.contradictions(labelled(spark, sf_dir)).select(F.md5("norm").alias("norm_md5"))


def drop_contradictory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.drop_contradictory(labelled(spark, sf_dir)).select("doc_id", "label")


def first_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.first_wins(labelled(spark, sf_dir), "doc_id").select("doc_id", "fate")


def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why rows leave the conversion, in the order of its tests."""
    d = curation.first_wins(labelled(spark, sf_dir), "doc_id")
    reason = F.when(~F.col("lang").isin("en", "de"), "language").when(T.signal_lines(F.col("text")) < 2, "low_signal").when(F.col("fate") != "kept", F.col("fate")).otherwise("added")
    return d.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def convert_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return converters.fix_samples(generated.frame(spark, sf_dir, "fixes"), emit_fixed=True)


def convert_line_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as one file: a line per turn, labelled by the turn's length, typed by its role."""
    c = table(spark, sf_dir, "conversations")
    turns = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    long = lambda t: (F.length(t["text"]) > 120).cast("int")
    rows = turns.select(
        "conv_id", F.transform("t", lambda t: t["text"]).alias("raw_lines"), F.lit(None).cast("array<string>").alias("lines"), F.transform("t", long).alias("label"),
        F.transform("t", lambda t: F.when(long(t) == 1, t["role"]).otherwise("0")).alias("type"),
    )
    return converters.line_label_samples(rows, "conv_id").select("conv_id", "label", "vulnerability_type", F.md5("source_code").alias("source_md5"))


def manifest_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return converters.manifest_violations(generated.frame(spark, sf_dir, "manifest"))


def pair_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of even id as vulnerable, of odd id as fixed twins of the same language and normalised text."""
    d = labelled(spark, sf_dir).withColumn("norm", T.normalise(F.col("text")))
    twins = curation.last_per_key(d.filter("label = 1"), ["lang", "norm"], "doc_id").select("lang", "norm", F.col("doc_id").alias("safe_id"))
    return d.filter("label = 0").join(twins, ["lang", "norm"], "left").select(F.col("doc_id").alias("vuln_id"), "safe_id", F.col("safe_id").isNotNull().alias("paired"))


def pair_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return converters.pair_report(samples(spark, sf_dir).withColumnRenamed("slm", "ratio"), "ratio")


def pair_quality_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return converters.pair_histogram(samples(spark, sf_dir), "slm")


def commit_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits, their parts as files."""
    files = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_partkey").alias("files"))
    return files.agg(F.count(F.lit(1)).alias("commits"), F.round(F.avg("files"), 3).alias("mean_files"), F.max("files").alias("max_files"), F.sum((F.col("files") > 1).cast("int")).cast("long").alias("multi_file"))


def candidate_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as candidates of their order's commit: returned ones (siblings) first, then by a seeded hash; at most two a
    commit, then at most 200 in all."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("sibling"))
    seed = converters.commit_seed(F.col("l_orderkey").cast("string"), 42)
    key = F.md5(F.concat_ws("|", seed.cast("string"), F.col("l_linenumber").cast("string")))
    rows = rows.withColumns({"seed": seed, "key": key}).withColumn("rank", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.col("sibling").desc(), "key", "l_linenumber"))).filter("rank <= 2")
    return rows.orderBy("key", "l_orderkey", "l_linenumber").limit(200).select("l_orderkey", "l_linenumber", "sibling", "seed", "rank")


def benign_reshape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return converters.benign_samples(samples(spark, sf_dir).filter("label = 0").select("sample_id", "project", "cwe"))


def benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items, but empty ones, whose text a document holds whole."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    return similarity.contained(table(spark, sf_dir, "documents").select("doc_id", "text"), items)


def exact_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each repeated text's documents, linked to the first."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return d.join(first, "h").filter("doc_id <> first_id").select("doc_id", "first_id")


def changed_line_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return converters.pair_changes(generated.frame(spark, sf_dir, "pairs"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = labelled(spark, sf_dir).select(F.col("doc_id").alias("id"), "lang", "text", "label")
    return d.filter("label = 1").drop("label"), d.filter("label = 0").drop("label")


def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one language and opposite labels whose token similarity is above 0.9: links between the least ids of
    documents of the same tokens, and the other ones (copies) with their least id."""
    safe, vulnerable = _sides(spark, sf_dir)
    return similarity.similar_classes(safe, vulnerable, 0.9, ["lang"]).withColumn("similarity", F.round("similarity", 6))


def near_dup_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe documents that resemble no vulnerable one above 0.75."""
    safe, vulnerable = _sides(spark, sf_dir)
    return similarity.drop_similar(safe, vulnerable, 0.75, ["lang"]).select(F.col("id").alias("doc_id"))


def training_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of contradictory and near-duplicate rows (of any language), and whether training may start (both below 5 %)."""
    d = labelled(spark, sf_dir)
    safe, vulnerable = _sides(spark, sf_dir)
    n, n_safe = d.count(), max(1, safe.count())
    bad = n - curation.drop_contradictory(d).count()
    near = n_safe - similarity.drop_similar(safe, vulnerable, 0.9, []).count()
    shares = (round(bad / max(1, n), 6), round(near / n_safe, 6))
    return spark.createDataFrame([(*shares, max(shares) < 0.05)], "contradictory double, near_duplicate double, allowed boolean")


def pair_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring documents as pairs, kept greedily."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("doc_id").cast("long").alias("pair"))
    half = d.select((F.col("pair") / 2).cast("long").alias("pair"), (F.col("doc_id") % 2).alias("side"), "text")
    pairs = half.filter("side = 0").select("pair", F.col("text").alias("vuln")).join(half.filter("side = 1").select("pair", F.col("text").alias("fixed")), "pair")
    return curation.greedy_pair_dedup(pairs, "pair", "vuln", "fixed", checkpointed(spark)).select("pair")


_L = "d AS (SELECT doc_id, text, lang, source, CAST(doc_id % 2 AS INTEGER) AS label FROM documents)"
_N = f"{_L}, n AS (SELECT *, {D.normalise('text')} AS norm FROM d)"
_C = "c AS (SELECT norm FROM n WHERE norm <> '' GROUP BY norm HAVING min(label) <> max(label))"
_F = "f AS (SELECT *, first_value(label) OVER w AS fl, row_number() OVER w AS rn FROM n WINDOW w AS (PARTITION BY norm ORDER BY doc_id))"
_FATE = "CASE WHEN rn = 1 THEN 'kept' WHEN label = fl THEN 'duplicate' ELSE 'contradiction' END"

QUERIES = {
    f.__name__: f
    for f in (
        normalize_text, tokens, signal_lines, noise_paths, contradictions, drop_contradictory, first_wins_dedup, skip_reasons, convert_fixes, convert_line_labels, manifest_violations, pair_join, pair_quality_report,
        pair_quality_histogram, commit_breadth, candidate_order, benign_reshape, benchmark_overlap, exact_dup_pairs, changed_line_ratio, near_dup_pairs, near_dup_guard, training_gate, pair_dedup,
    )
}

ORACLES = {
    "normalize_text": f"SELECT doc_id, md5({D.normalise('text')}) AS norm_md5, length({D.normalise('text')}) AS norm_chars, len({D.lines('text')}) AS n_lines FROM documents",
    "tokens": f"WITH t AS (SELECT doc_id, {D.tokens('text')} AS t FROM documents) SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM t",
    "signal_lines": f"WITH t AS (SELECT doc_id, {D.signal_lines('text')} AS signal FROM documents) SELECT doc_id, signal, signal >= 2 AS kept FROM t",
    "noise_paths": f"WITH p AS ({generated.sql('paths')}) SELECT id, {D.noise_path('path')} AS noise FROM p",
    "contradictions": f"WITH {_N}, {_C} SELECT md5(norm) AS norm_md5 FROM c",
    "drop_contradictory": f"WITH {_N}, {_C} SELECT doc_id, label FROM n WHERE norm NOT IN (SELECT norm FROM c)",
    "first_wins_dedup": f"WITH {_N}, {_F} SELECT doc_id, {_FATE} AS fate FROM f",
    "skip_reasons": f"WITH {_N}, {_F} SELECT CASE WHEN lang NOT IN ('en', 'de') THEN 'language' WHEN {D.signal_lines('text')} < 2 THEN 'low_signal' WHEN {_FATE} <> 'kept' THEN {_FATE} ELSE 'added' END AS reason, count(*) AS n FROM f GROUP BY 1",
    "convert_fixes": converters.fix_samples_sql(generated.sql("fixes")),
    "convert_line_labels": f"""WITH t AS (SELECT conv_id, turn, text, CASE WHEN length(text) > 120 THEN 1 ELSE 0 END AS label, role FROM conversations),
k AS (SELECT conv_id, role, count(*) AS n, min(turn) AS pos FROM t WHERE label = 1 GROUP BY conv_id, role), m AS (SELECT conv_id, first(role ORDER BY n DESC, pos) AS kind FROM k GROUP BY conv_id),
a AS (SELECT conv_id, max(label) AS label, string_agg(text, chr(10) ORDER BY turn, role, text) AS src FROM t GROUP BY conv_id)
SELECT conv_id, CAST(label AS INTEGER) AS label, coalesce(kind, 'unknown') AS vulnerability_type, md5({D.strip('src')}) AS source_md5 FROM a LEFT JOIN m USING (conv_id) WHERE {D.strip('src')} <> ''""",
    "manifest_violations": converters.manifest_violations_sql(generated.sql("manifest")),
    "pair_join": f"WITH {_N}, t AS (SELECT lang, norm, max(doc_id) AS safe_id FROM n WHERE label = 1 GROUP BY lang, norm) SELECT doc_id AS vuln_id, safe_id, safe_id IS NOT NULL AS paired FROM n LEFT JOIN t USING (lang, norm) WHERE label = 0",
    "pair_quality_report": f"""WITH {S} SELECT count(*) AS pairs, round(avg(CASE WHEN slm = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS trivial_share, round(avg(CASE WHEN slm > 0.5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS substantial_share,
round(avg(slm), 6) AS mean_ratio, list_sort(list(slm))[count(*) // 2 + 1] AS median_ratio FROM s""",
    "pair_quality_histogram": f"""WITH {S}, b(bucket, lo, hi) AS (VALUES ('0-10%', 0.0::DOUBLE, 0.1::DOUBLE), ('10-25%', 0.1, 0.25), ('25-50%', 0.25, 0.5), ('50-75%', 0.5, 0.75), ('75-100%', 0.75, 2))
SELECT bucket, count(s.slm) AS n FROM b LEFT JOIN s ON s.slm >= lo AND s.slm < hi GROUP BY bucket""",
    "commit_breadth": "WITH f AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS files FROM lineitem GROUP BY l_orderkey) SELECT count(*) AS commits, round(avg(files), 3) AS mean_files, max(files) AS max_files, count(*) FILTER (files > 1) AS multi_file FROM f",
    "candidate_order": """WITH x AS (SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS sibling, (42 + ('0x' || substr(md5(CAST(l_orderkey AS VARCHAR)), 1, 8))::BIGINT) & 2147483647 AS seed FROM lineitem),
y AS (SELECT *, md5(seed || '|' || l_linenumber) AS key FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY sibling DESC, key, l_linenumber) AS rank FROM y)
SELECT l_orderkey, l_linenumber, sibling, seed, rank FROM z WHERE rank <= 2 ORDER BY key, l_orderkey, l_linenumber LIMIT 200""",
    "benign_reshape": f"""WITH {S} SELECT 'benign_' || substr(sha256('benign|' || sample_id), 1, 16) AS sample_id, 'benign::' || project AS project, 0 AS label, 'none' AS vulnerability_type, 'benign_control' AS sample_subtype, 1 AS start_line FROM s WHERE label = 0""",
    "benchmark_overlap": "SELECT DISTINCT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON length(b.text) > 0 AND contains(d.text, b.text)",
    "exact_dup_pairs": "SELECT doc_id, first_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents) WHERE doc_id <> first_id",
}
