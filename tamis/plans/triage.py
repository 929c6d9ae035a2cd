"""Triage: findings, intervals, chunks, reports; rules over text; retrieval; splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamis.functions import gates
from tamis.functions import text as T
from tamis.operators import intervals, retrieval, splits
from tamis.plans import dialect as D
from tamis.plans.samples import S, samples, table


def _ranges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Conversation turns as functions of ten lines, and findings that the texts' lengths place among them."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.max(F.length("text")).alias("n"))
    sample = c.select(F.concat_ws("-", "conv_id", "turn").alias("sample_id"), F.col("conv_id").alias("file"), (F.col("turn") * 10).alias("start"), (F.col("turn") * 10 + 9).alias("end"))
    severity = F.element_at(F.array(*map(F.lit, ("INFO", "WARNING", "ERROR"))), (F.col("n") % 3 + 1).cast("int"))
    start = F.col("turn") * 10 + F.col("n") % 17
    finding = c.filter("n % 4 <> 0").select(F.col("conv_id").alias("file"), start.alias("start"), (start + F.col("n") % 5).alias("end"), severity.alias("severity"), gates.severity_weight(severity).alias("weight"), F.col("turn").alias("ord"))
    return sample, finding


def severity_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample, finding = _ranges(spark, sf_dir)
    return intervals.strongest_overlap(sample, finding).select("sample_id", "severity")


def point_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that hold the first line of a finding."""
    sample, finding = _ranges(spark, sf_dir)
    return intervals.ranges_with_points(sample, finding.select("file", F.col("start").alias("at"))).select("sample_id")


def _chunks(spark: SparkSession, sf_dir: str, size: int = 8, overlap: int = 2) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.chunks(F.col("text"), size, overlap)).alias("c")).select("doc_id", "c.*")


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("doc_id", "chunk_index", "start_line", "end_line", F.md5("text").alias("text_md5"))


def chunk_documents_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, 64, 8).select("doc_id", "chunk_index", "start_line", "end_line", F.md5("text").alias("text_md5"))


def hunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that overlap lines 4 to 6, of documents with several chunks."""
    c = _chunks(spark, sf_dir).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    return c.filter("n > 1 AND start_line <= 6 AND end_line >= 4").select("doc_id", "chunk_index")


def scored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with a synthetic probability to four decimals."""
    p = ((F.col("doc_id") * 31 + F.length("text") * 7919) % 10000).cast("double") / 10000
    return _chunks(spark, sf_dir).withColumn("prob", p)


def chunk_score_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximum and mean of each document's chunk scores, 0 without chunks."""
    scores = scored_chunks(spark, sf_dir).groupBy("doc_id").agg(F.max("prob").alias("mx"), F.avg("prob").alias("mean"))
    return table(spark, sf_dir, "documents").select("doc_id").join(scores, "doc_id", "left").select("doc_id", F.coalesce("mx", F.lit(0.0)).alias("max_score"), F.round(F.coalesce("mean", F.lit(0.0)), 6).alias("mean_score"))


def topk_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(F.col("prob").desc(), "chunk_index")
    return scored_chunks(spark, sf_dir).withColumn("rank", F.row_number().over(w)).filter("rank <= 5").select("doc_id", "rank", "chunk_index", "prob")


def triage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per sample: score from its chunks, risk, escalation and, if escalated, its five most suspicious chunks."""
    s = samples(spark, sf_dir).select(F.col("sample_id").alias("doc_id"), "sev")
    c = scored_chunks(spark, sf_dir)
    w = Window.partitionBy("doc_id").orderBy(F.col("prob").desc(), "chunk_index")
    top = c.withColumn("r", F.row_number().over(w)).groupBy("doc_id").agg(F.max("prob").alias("score"), F.array_sort(F.collect_list(F.when(F.col("r") <= 5, F.struct("r", "chunk_index")))).alias("t"))
    j = s.join(top, "doc_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    risk = F.round(gates.risk(F.col("sev"), F.col("score"), 0.4, 0.6), 4)
    chunks = F.when(risk >= 0.52, F.array_join(F.transform("t", lambda x: x["chunk_index"].cast("string")), ",")).otherwise("")
    return j.select("doc_id", F.round("score", 4).alias("score"), risk.alias("risk"), (risk >= 0.52).alias("escalate"), F.coalesce(chunks, F.lit("")).alias("suspicious_chunks"))


def triage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = triage_report(spark, sf_dir)
    return r.agg(F.count(F.lit(1)).alias("findings"), F.sum(F.col("escalate").cast("int")).cast("long").alias("escalated"), F.when(F.bool_or("escalate"), "VULNERABLE").otherwise("SAFE").alias("status"))


#: Pattern rules for the prose tables: a syntactic stand-in for static analysis, not taint analysis.
RULES = [("secret-assignment", "(?i)(password|secret|api_key|token)=", "ERROR"), ("e-mail", r"[a-z0-9._]+@[a-z0-9]+\.[a-z]+", "INFO"), ("licence-line", "(?i)licensed under", "INFO"), ("inline-script", "<script", "WARNING")]


def rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, row_id, line, rule_id, severity): lines of documents and pages that match a rule; rules stay a literal."""
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("source"), F.col("doc_id").alias("row_id"), "text")
    pages = table(spark, sf_dir, "pages").select(F.lit("pages").alias("source"), F.col("page_id").alias("row_id"), F.col("html").alias("text"))
    rows = docs.unionByName(pages).select("source", "row_id", F.posexplode(T.lines(F.col("text"))).alias("pos", "line"))
    hits = F.filter(F.array(*(F.when(F.col("line").rlike(p), F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"))) for r, p, s in RULES)), lambda x: x.isNotNull())
    return rows.select("source", "row_id", (F.col("pos") + 1).alias("line"), F.explode(hits).alias("h")).select("source", "row_id", "line", "h.*")


def line_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.line_slice(F.col("text"), F.lit(2), F.lit(4))).alias("slice_md5"))


def safe_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_replace("url", r"[^A-Za-z0-9_.-]", "_").alias("file_name"), F.regexp_replace(F.translate("url", "\\", "/"), r"^https?://", "").alias("relative"))


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return retrieval.vector_topk(e, e.filter("vec_id % 50 = 0"), 3)


def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring vectors."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(n, "vec_id").select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("next")), 6).alias("similarity"))


def one_hop_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as functions: each calls the next two keys and is called by the keys that share its region."""
    n = table(spark, sf_dir, "nation")
    members = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_nationkey")).alias("m"))
    blocks = n.join(members, "n_regionkey").select(F.col("n_nationkey").alias("name"), F.array(F.col("n_nationkey") + 1, F.col("n_nationkey") + 2).alias("calls_out"), F.array_remove("m", F.col("n_nationkey")).alias("calls_in"))
    return retrieval.one_hop(blocks)


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").filter((F.col("c_nationkey") == 7) & (F.col("c_mktsegment") == "BUILDING")).orderBy("c_custkey").limit(1).select("c_custkey", "c_name")


def embedding_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to add to a store that has the even ones, by their text's hash; the first of each hash."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("file_hash"))
    fresh = d.filter("doc_id % 2 = 1").join(d.filter("doc_id % 2 = 0").select("file_hash").distinct(), "file_hash", "left_anti")
    return fresh.groupBy("file_hash").agg(F.min("doc_id").alias("doc_id"))


def repo_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates less modified files: parts never returned in bulk."""
    returned = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey").join(returned, "p_partkey", "left_anti")


def distinct_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("project").distinct()


def bag_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary samples and the benign projects beside them, repeats kept."""
    s = samples(spark, sf_dir).select("sample_id", "project", "label")
    return s.unionByName(s.filter("label = 0").withColumn("project", F.concat(F.lit("benign::"), "project")))


def split_by_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_by_project(samples(spark, sf_dir)).select("sample_id", "project", "split")


def split_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_stratified(samples(spark, sf_dir), "sample_id", ["project", "label"]).select("sample_id", "split")


def split_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels per split of the split by project."""
    return splits.split_by_project(samples(spark, sf_dir)).groupBy("split").agg(F.countDistinct("label").alias("labels"), F.countDistinct("project").alias("projects"))


def cap_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.cap(samples(spark, sf_dir), "sample_id", 300, {"cwe": 60, "label": 50}).select("sample_id", "cwe", "label")


def select_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).groupBy("project").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "project").limit(5)


def assign_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    benign = s.filter("label = 0").withColumn("project", F.concat(F.lit("benign::"), "project"))
    return splits.assign_repositories(s.filter("label = 1").unionByName(benign)).select("sample_id", "project", "split")


def gate_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples, labels and mean score per split."""
    s = splits.split_by_project(samples(spark, sf_dir))
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("vulnerable"), F.round(F.avg("slm"), 6).alias("mean_score"))


_RANGES = """c AS (SELECT conv_id, turn, max(length(text)) AS n FROM conversations GROUP BY conv_id, turn),
sa AS (SELECT conv_id || '-' || turn AS sample_id, conv_id AS file, turn * 10 AS s, turn * 10 + 9 AS e FROM c),
fi AS (SELECT conv_id AS file, turn * 10 + n % 17 AS s, turn * 10 + n % 17 + n % 5 AS e, n % 3 AS sv, turn AS ord FROM c WHERE n % 4 <> 0)"""


def chunk_oracle(size: int, overlap: int) -> str:
    stride = size - overlap
    return f"""l AS (SELECT doc_id, {D.lines('text')} AS ls FROM documents), p AS (SELECT doc_id, ls, len(ls) AS n, unnest(generate_series(0, CAST(ceil(greatest(0, len(ls) - {size}) / {stride}.0) AS BIGINT))) AS k FROM l WHERE len(ls) > 0),
q AS (SELECT doc_id, n, k * {stride} + 1 AS start_line, least(k * {stride} + {size}, n) AS end_line, ls[k * {stride} + 1 : k * {stride} + {size}] AS part FROM p),
ch AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start_line) - 1 AS chunk_index, start_line, end_line, array_to_string(part, chr(10)) AS text FROM q WHERE n <= {size} OR len(list_filter(part, lambda l: {D.has_signal('l')})) >= 2)"""


_CH = chunk_oracle(8, 2)
_SC = f"{_CH}, sc AS (SELECT *, CAST((doc_id * 31 + length(text) * 7919) % 10000 AS DOUBLE) / 10000 AS prob FROM ch), rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY prob DESC, chunk_index) AS r FROM sc)"
_REPORT = f"""{S}, {_SC}, tp AS (SELECT doc_id, max(prob) AS score, string_agg(CAST(chunk_index AS VARCHAR), ',' ORDER BY r) FILTER (r <= 5) AS t FROM rk GROUP BY doc_id),
j AS (SELECT sample_id AS doc_id, coalesce(score, 0) AS score, round(0.4::DOUBLE * sev + 0.6::DOUBLE * coalesce(score, 0), 4) AS risk, t FROM s LEFT JOIN tp ON tp.doc_id = s.sample_id),
rp AS (SELECT doc_id, round(score, 4) AS score, risk, risk >= 0.52::DOUBLE AS escalate, CASE WHEN risk >= 0.52::DOUBLE THEN coalesce(t, '') ELSE '' END AS suspicious_chunks FROM j)"""
_COS = "CASE WHEN sqrt(list_sum(list_transform({a}, lambda x: x::DOUBLE * x))) = 0 OR sqrt(list_sum(list_transform({b}, lambda x: x::DOUBLE * x))) = 0 THEN 0 ELSE list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2])) / (sqrt(list_sum(list_transform({a}, lambda x: x::DOUBLE * x))) * sqrt(list_sum(list_transform({b}, lambda x: x::DOUBLE * x)))) END"
_BY_PROJECT = f"""{S}, pr AS (SELECT project, row_number() OVER (ORDER BY md5('42|' || project), project) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT project FROM s)),
sz AS (SELECT *, least(greatest(1, round_even(n * 0.2, 0)), n - 2) AS nt FROM pr), sp AS (SELECT *, CASE WHEN r <= nt THEN 'test' WHEN r <= nt + least(greatest(1, round_even(n * 0.2, 0)), n - nt - 1) THEN 'validation' ELSE 'train' END AS split FROM sz)"""

QUERIES = {
    f.__name__: f
    for f in (
        severity_overlap_join, point_in_interval, chunk_documents, chunk_documents_default, hunk_overlap, chunk_score_agg, topk_chunks, triage_report, triage_status, rule_findings, line_slices, safe_file_names, vector_topk,
        cosine_pairs, one_hop_context, point_lookup, embedding_append, repo_snapshot_diff, distinct_projects, bag_union, split_by_project, split_stratified, split_guard, cap_samples, select_projects, assign_repositories,
        gate_by_split,
    )
}

_RULE_SQL = " UNION ALL ".join(f"SELECT source, row_id, line, '{r}' AS rule_id, '{s}' AS severity FROM x WHERE regexp_matches(t, '{p}')" for r, p, s in RULES)

ORACLES = {
    "severity_overlap_join": f"""WITH {_RANGES}, h AS (SELECT sample_id, sv, ord FROM sa JOIN fi ON sa.file = fi.file AND fi.s <= sa.e AND fi.e >= sa.s),
b AS (SELECT sample_id, first(sv ORDER BY sv DESC, ord) AS sv FROM h GROUP BY sample_id) SELECT sample_id, CASE sv WHEN 0 THEN 'INFO' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'ERROR' ELSE 'NONE' END AS severity FROM sa LEFT JOIN b USING (sample_id)""",
    "point_in_interval": f"WITH {_RANGES} SELECT DISTINCT sample_id FROM sa JOIN fi ON sa.file = fi.file AND fi.s BETWEEN sa.s AND sa.e",
    "chunk_documents": f"WITH {_CH} SELECT doc_id, chunk_index::INTEGER AS chunk_index, start_line::INTEGER AS start_line, end_line::INTEGER AS end_line, md5(text) AS text_md5 FROM ch",
    "chunk_documents_default": f"WITH {chunk_oracle(64, 8)} SELECT doc_id, chunk_index::INTEGER AS chunk_index, start_line::INTEGER AS start_line, end_line::INTEGER AS end_line, md5(text) AS text_md5 FROM ch",
    "hunk_overlap": f"WITH {_CH}, m AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS cnt FROM ch) SELECT doc_id, chunk_index::INTEGER AS chunk_index FROM m WHERE cnt > 1 AND start_line <= 6 AND end_line >= 4",
    "chunk_score_agg": f"WITH {_SC}, a AS (SELECT doc_id, max(prob) AS mx, avg(prob) AS mean FROM sc GROUP BY doc_id) SELECT d.doc_id, coalesce(mx, 0) AS max_score, round(coalesce(mean, 0), 6) AS mean_score FROM documents d LEFT JOIN a USING (doc_id)",
    "topk_chunks": f"WITH {_SC} SELECT doc_id, r::INTEGER AS rank, chunk_index::INTEGER AS chunk_index, prob FROM rk WHERE r <= 5",
    "triage_report": f"WITH {_REPORT} SELECT * FROM rp",
    "triage_status": f"WITH {_REPORT} SELECT count(*) AS findings, count(*) FILTER (escalate) AS escalated, CASE WHEN bool_or(escalate) THEN 'VULNERABLE' ELSE 'SAFE' END AS status FROM rp",
    "rule_findings": f"""WITH u AS (SELECT 'documents' AS source, doc_id AS row_id, {D.lines('text')} AS ls FROM documents UNION ALL SELECT 'pages', page_id, {D.lines('html')} FROM pages),
x AS (SELECT source, row_id, unnest(ls) AS t, generate_subscripts(ls, 1)::INTEGER AS line FROM u) {_RULE_SQL}""",
    "line_slices": f"SELECT doc_id, md5(array_to_string({D.lines('text')}[2:4], chr(10))) AS slice_md5 FROM documents",
    "safe_file_names": r"SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_.-]', '_', 'g') AS file_name, regexp_replace(translate(url, '\', '/'), '^https?://', '') AS relative FROM pages",
    "vector_topk": f"""WITH x AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round({_COS.format(a='e.embedding', b='q.embedding')}, 6) AS similarity FROM embeddings e JOIN embeddings q ON q.vec_id % 50 = 0),
y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM x) SELECT query_id, rank, id, similarity FROM y WHERE rank <= 3""",
    "cosine_pairs": f"SELECT a.vec_id, round({_COS.format(a='a.embedding', b='b.embedding')}, 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "one_hop_context": """WITH o AS (SELECT n_nationkey AS name, n_nationkey + d AS other, 'callee' AS relation FROM nation, (VALUES (1), (2)) AS k(d)),
i AS (SELECT a.n_nationkey AS name, b.n_nationkey AS other, 'caller' AS relation FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey)
SELECT * FROM i UNION SELECT * FROM o WHERE other IN (SELECT n_nationkey FROM nation) AND (name, other) NOT IN (SELECT name, other FROM i)""",
    "point_lookup": "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7 AND c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 1",
    "embedding_append": "SELECT sha256(text) AS file_hash, min(doc_id) AS doc_id FROM documents WHERE doc_id % 2 = 1 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0) GROUP BY text",
    "repo_snapshot_diff": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40)",
    "distinct_projects": f"WITH {S} SELECT DISTINCT project FROM s",
    "bag_union": f"WITH {S} SELECT sample_id, project, label FROM s UNION ALL SELECT sample_id, 'benign::' || project, label FROM s WHERE label = 0",
    "split_by_project": f"WITH {_BY_PROJECT} SELECT sample_id, project, split FROM s JOIN sp USING (project)",
    "split_stratified": f"""WITH {S}, x AS (SELECT *, row_number() OVER (PARTITION BY project, label ORDER BY md5('42|' || sample_id), sample_id) AS r, round_even(count(*) OVER (PARTITION BY project, label) * 0.2, 0) AS k FROM s)
SELECT sample_id, CASE WHEN r <= k THEN 'test' WHEN r <= 2 * k THEN 'validation' ELSE 'train' END AS split FROM x""",
    "split_guard": f"WITH {_BY_PROJECT} SELECT split, count(DISTINCT label) AS labels, count(DISTINCT project) AS projects FROM s JOIN sp USING (project) GROUP BY split",
    "cap_samples": f"""WITH {S}, a AS (SELECT *, md5('42|' || sample_id) AS k FROM s), b AS (SELECT * FROM a ORDER BY k, sample_id LIMIT 300), c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY cwe ORDER BY k, sample_id) <= 60)
SELECT sample_id, cwe, label FROM c QUALIFY row_number() OVER (PARTITION BY label ORDER BY k, sample_id) <= 50""",
    "select_projects": f"WITH {S} SELECT project, count(*) AS n FROM s GROUP BY project ORDER BY n DESC, project LIMIT 5",
    "gate_by_split": f"WITH {_BY_PROJECT} SELECT split, count(*) AS n, sum(label)::BIGINT AS vulnerable, round(avg(slm), 6) AS mean_score FROM s JOIN sp USING (project) GROUP BY split",
}
