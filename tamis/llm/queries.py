"""One query per operator, over its whole table, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tamis.llm import bagminhash, decontaminate, html_extract, license_scan, mixing, quality_rules, suffix_dedup, token_store, toxicity, url_rules
from tamis.llm.common import scratch, table

#: The url rules of the query (fixed values): host, path, verdict.
URL_RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: Fixed values of the token query.
TOKENIZER, END_ID = "word_bpe_49k.json", 2


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract_pages(pages).select("page_id", "url", "text").withColumn("n_chars", F.length("text").cast("long"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.find_repeats(table(spark, sf_dir, "documents")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(table(spark, sf_dir, "documents")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", "toxic_words")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.classes(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.assign(table(spark, sf_dir, "documents"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    token_store.write_store(table(spark, sf_dir, "documents"), path, token_store.public_file(TOKENIZER), END_ID)
    return token_store.digest(token_store.read_store(spark, path))


_RULE_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

def _mixing_sql(fraction: float = 0.5, rounds: int = mixing.ROUNDS) -> str:
    steps, last = [], "c0"
    for k in range(rounds):
        for key in ("source", "lang", "topic"):
            steps.append(f"r{k}_{key} AS (SELECT * REPLACE (CASE WHEN now > 0 THEN least(CAST(tokens AS DOUBLE), w * ({key}_share * (total * CAST({fraction} AS DOUBLE))) / now) ELSE 0 END AS w) FROM (SELECT * EXCLUDE (now), sum(w) OVER (PARTITION BY {key}) AS now FROM {last}))")
            last = f"r{k}_{key}"
    shares = ", ".join(f"s_{k} AS (SELECT {k}, w / sum(w) OVER () AS {k}_share FROM (SELECT {k}, sqrt(sum(tokens)) AS w FROM c GROUP BY {k}))" for k in ("source", "lang", "topic"))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
e AS (SELECT *, CASE WHEN 5 * (length(text) - length(replace(text, '|', ''))) > n_tokens THEN 'table' WHEN n_tokens < 100 THEN 'note' WHEN n_tokens < 1000 THEN 'article' ELSE 'long' END AS topic FROM d),
c AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM e GROUP BY ALL),
{shares},
c0 AS (SELECT *, tokens * CAST({fraction} AS DOUBLE) AS w, sum(tokens) OVER () AS total, CAST(0 AS DOUBLE) AS now FROM c JOIN s_source USING (source) JOIN s_lang USING (lang) JOIN s_topic USING (topic)),
{", ".join(steps)},
p AS (SELECT source, lang, topic, CASE WHEN tokens = 0 THEN 1 ELSE round(w / tokens, {mixing.DECIMALS}) END AS p FROM {last})
SELECT doc_id, source, lang, topic, n_tokens, p, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0 < p AS sampled FROM e JOIN p USING (source, lang, topic)"""


def _license_sql() -> str:
    known, ordered = license_scan.sentences(), license_scan.rules()
    values = ", ".join(f"('{text}', '{name}')" for text, name in known.items())
    run = "'|' || array_to_string(ids, '||') || '|'"
    for pattern, licence in ordered:
        run = f"replace({run}, '|{'||'.join(pattern)}|', '|={licence}|')"
    category = " ".join(f"WHEN len(list_filter(licenses, lambda x: regexp_matches(x, '{p}'))) > 0 THEN '{name}'" for name, p in license_scan.CATEGORIES)
    return rf"""
WITH k(t, name) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS rn, doc_id, regexp_replace(regexp_replace(regexp_replace(translate(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(13) || chr(11), 'abcdefghijklmnopqrstuvwxyz' || chr(10) || ' '), '{license_scan.VERSION}', '\1v \2', 'g'), '{license_scan.CUT}', chr(11), 'g'), '{license_scan.OTHER}', ' ', 'g') AS t FROM documents),
s AS (SELECT rn, x, i, trim(regexp_replace(x, '[ \n]+', ' ', 'g'), ' ') AS whole FROM (SELECT rn, unnest(string_split(t, chr(11))) AS x, generate_subscripts(string_split(t, chr(11)), 1) AS i FROM d)),
l AS (SELECT rn, i, trim(unnest(string_split(x, chr(10))), ' ') AS x, generate_subscripts(string_split(x, chr(10)), 1) AS j FROM s WHERE whole NOT IN (SELECT t FROM k)),
f AS (SELECT rn, list(name ORDER BY i, j) AS ids FROM (SELECT rn, i, 0 AS j, name FROM s JOIN k ON s.whole = k.t UNION ALL SELECT rn, i, j, name FROM l JOIN k ON l.x = k.t) GROUP BY rn),
m AS (SELECT rn, ids, list_sort(list_distinct(list_transform(list_filter(string_split({run}, '|'), lambda x: starts_with(x, '=')), lambda x: substr(x, 2)))) AS licenses FROM f)
SELECT d.doc_id, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids, coalesce(array_to_string(licenses, ','), '') AS licenses,
       CASE WHEN coalesce(len(licenses), 0) = 0 THEN 'none' {category} ELSE 'permissive' END AS category
FROM d LEFT JOIN m USING (rn)"""


ORACLES = {
    "op5_license_scan": _license_sql(),
    "op9_mixing": _mixing_sql(),
    "op1_decontaminate": f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
s AS (SELECT item, w, CAST(least(13, len(w)) AS BIGINT) AS n FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM (SELECT item, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM s)),
lens AS (SELECT DISTINCT n FROM win),
dp AS (SELECT rn, n, i, array_to_string(w[i:i + n - 1], ' ') AS t FROM (SELECT rn, n, w, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT dp.rn, dp.i, dp.n, win.item FROM dp JOIN win ON dp.t = win.t AND dp.n = win.n),
pos AS (SELECT rn, count(DISTINCT p) AS n_hit FROM (SELECT rn, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY rn),
its AS (SELECT rn, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rn, item FROM hit) GROUP BY rn)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos USING (rn) LEFT JOIN its USING (rn)""",
    "op8_url_filter": f"""
WITH r(host, path, verdict) AS (VALUES {_RULE_VALUES}),
u AS (SELECT page_id, row_number() OVER () AS rn,
        coalesce(translate(regexp_extract(url, '^(.*?)://([^/?#]*)([^?#]*)', 2, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(url, '^(.*?)://([^/?#]*)([^?#]*)', 3, 's'), '') AS path FROM pages),
m AS (SELECT u.rn, max_by(r.host || r.path, length(r.host || r.path) * 1000 + length(r.host)) AS rule, max_by(r.verdict, length(r.host || r.path) * 1000 + length(r.host)) AS verdict
      FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY u.rn)
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (rn)""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_html_extract": op2_html_extract,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_license_scan": op5_license_scan,
    "op6_toxicity": op6_toxicity,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_url_filter": op8_url_filter,
    "op9_mixing": op9_mixing,
    "op10_token_store": op10_token_store,
    "pipeline": corpus_pipeline.run,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})


