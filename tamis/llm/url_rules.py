"""URL filters by a sort-merge range join (DataFrame functions only).

A rule is (host, path, verdict); it fits a url whose host is the rule's host or a subdomain of it and whose path
starts with the rule's path. Hosts are keyed from the right (each url stands once under every suffix of its host that
could be a rule's host), so that below one host a rule's path is the interval [path, path + 0xFF) of the byte-ordered
paths. Rule openings, urls and rule closings are sorted together and swept once: an opening pushes its rule, a closing
returns to the enclosing rule, so the last event before a url names the top of the stack, the longest rule that fits.

Defined results: a null url, or one without "://", has empty host and path. No rule: rule is null, verdict is
`default`. Rules that repeat a (host, path): the verdict that sorts first holds. Rules of equal length that fit one
url: the one with the longer host. Repeated rows stay repeated. Rules with a null host or path are left out. Columns
other than the two named are not read.

Only urls below a rule's host are swept; the others meet no sort. Hot hosts: the sweep runs per (host, salt), with a
salt for every `rows_per_salt` urls below that host, so that the events of its rules, and of no other, are repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.common import materialize

#: Rows that one sweep task is meant to sort.
ROWS_PER_SALT = 1_000_000
#: Rule hosts up to which they are sent to every executor.
BROADCAST_HOSTS = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2), F.lit(""))


def _suffixes(host: Column, levels: int) -> Column:
    """The host's suffixes of up to `levels` labels."""
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), F.least(n, F.lit(levels))), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))


def rule_events(rules: DataFrame) -> DataFrame:
    """Openings (kind 0) and closings (kind 2) in key order, each with the rule on top of the stack after it."""
    rules = (
        rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull())
        .groupBy(F.translate("host", _UPPER, _LOWER).alias("host"), "path").agg(F.min("verdict").alias("verdict"))
        .withColumn("top", F.struct(F.concat("host", "path").alias("rule"), "verdict", F.length(F.concat("host", "path")).alias("len"), F.length("host").alias("host_len")))
    )
    nothing = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("int").alias("len"), F.lit(None).cast("int").alias("host_len"))
    shorter = F.transform(F.sequence(F.lit(0), F.length("path") - 1), lambda k: F.substring(F.col("path"), F.lit(1), k))
    enclosing = (
        rules.filter(F.length("path") > 0).select("host", "path", F.explode(shorter).alias("outer"))
        .join(rules.select("host", F.col("path").alias("outer"), F.col("top").alias("outer_top")), ["host", "outer"])
        .groupBy("host", "path").agg(F.max_by("outer_top", F.length("outer")).alias("below"))
    )
    nested = rules.join(enclosing, ["host", "path"], "left")
    key = F.encode("path", "UTF-8")
    opening = nested.select("host", key.alias("key"), F.lit(0).alias("kind"), "top")
    closing = nested.select("host", F.concat(key, F.unhex(F.lit("FF"))).alias("key"), F.lit(2).alias("kind"), F.coalesce("below", nothing).alias("top"))
    return opening.unionByName(closing)


def rule_hosts(urls: DataFrame, rules: DataFrame, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """(host, salts) of the hosts of `rules`; a column `hosts` of `urls` holds the suffixes that each row stands under."""
    hosts = rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull()).select(F.translate("host", _UPPER, _LOWER).alias("host")).distinct()
    known = F.broadcast(hosts) if hosts.count() <= BROADCAST_HOSTS else hosts
    below = urls.select(F.explode("hosts").alias("host")).join(known, "host", "left_semi").groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    return below.select("host", F.ceil(F.col("n") / rows_per_salt).cast("int").alias("salts"))


def judge_urls(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """One row per row of `urls`: id, url, host, path, rule, verdict."""
    levels = rules.agg(F.max(F.size(F.split("host", r"\.", -1)))).first()[0] or 1
    plain = urls.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    hosts = rule_hosts(plain.select(_suffixes(url_host(F.col("url")), levels).alias("hosts")), rules, rows_per_salt)
    hosts = materialize(hosts, "hosts")
    hosts = F.broadcast(hosts) if hosts.count() <= BROADCAST_HOSTS else hosts
    distinct = plain.groupBy("id", "url").agg(F.count(F.lit(1)).alias("copies"))
    distinct = distinct.withColumn("full_host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))

    events = rule_events(rules).join(hosts, "host").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select(
        "host", "salt", "key", "kind", "top", *(F.lit(None).cast(t).alias(c) for c, t in (("id", distinct.schema["id"].dataType), ("url", "string"), ("copies", "long"), ("full_host", "string"), ("path", "string")))
    )
    no_top = F.lit(None).cast(events.schema["top"].dataType).alias("top")
    probes = distinct.withColumn("host", F.explode(_suffixes(F.col("full_host"), levels))).join(hosts, "host").select(
        "host", F.pmod(F.xxhash64("id", "url"), F.col("salts")).cast("int").alias("salt"), F.encode("path", "UTF-8").alias("key"), F.lit(1).alias("kind"), no_top, "id", "url", "copies", "full_host", "path",
    )
    sweep = Window.partitionBy("host", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = events.unionByName(probes).withColumn("top", F.last("top", ignorenulls=True).over(sweep)).filter(F.col("kind") == 1)
    row = ["id", "url", "copies", "full_host", "path"]
    best = swept.select(*row, "top").unionByName(distinct.select(*row, no_top)).groupBy(*row).agg(
        F.max(F.when(F.col("top.rule").isNotNull(), F.struct("top.len", "top.host_len", "top.rule", "top.verdict"))).alias("best")
    )
    return best.select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), F.col("full_host").alias("host"), "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"),
    ).drop("_copy")
