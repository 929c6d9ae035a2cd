import random
import re

import pytest

from tamis.llm import url_rules as U


def brute(url, rules, default="allow"):
    m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[2]), m[3]) if m else ("", "")
    fit = [(len(h + p), len(h), h + p, v) for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, default))
    return host, path, best[2], best[3]


URLS = [
    None, "", "no scheme", "http://", "http://COM/en/7?x#y", "https://a.example.com/en/7", "https://a.example.com/en/8", "x://y://z/en/", "http://example.com", "http://example.com?en/", "http://example.net/de/81/x",
    "http://www.example.net/de/", "http://notexample.com/en/", "http://a..org/es/", "http://org/es", "http://.org/es/", "http://user@host.org:80/es/é", "http://example.com/en/7", "http://example.com/en/7", "http://a.b.c.d.e.f.example.com/en/" + "z" * 5000,
]


@pytest.mark.parametrize(("rows_per_salt", "broadcast"), [(U.ROWS_PER_SALT, U.BROADCAST_HOSTS), (10, 0)])
def test_matches_brute_force(spark, monkeypatch, rows_per_salt, broadcast):
    monkeypatch.setattr(U, "BROADCAST_HOSTS", broadcast)
    rng = random.Random(2)
    rules = {("com", "/en/"): "block", ("example.com", "/en/7"): "allow", ("net", "/de/"): "allow", ("example.net", "/de/8"): "block", ("org", "/es/"): "block", ("example.com", ""): "block", ("a.com", "/p/q/r"): "allow", ("a.com", "/p/q"): "block", ("a.com", "/p"): "allow"}
    hosts, paths = ["a.com", "x.a.com", "example.com", "b.net", "com"], ["/p", "/p/q/", "/p/q/r/s", "/pq", "/en/7/", "/e", ""]
    urls = URLS + [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q', '#f'])}" for _ in range(300)]
    rows = list(enumerate(urls)) + [(None, "http://example.com/en/70")]
    pages = spark.createDataFrame([(i, u, "k") for i, u in rows], "page_id long, url string, host string")
    table = spark.createDataFrame([(h, p, v) for (h, p), v in rules.items()] + [("com", "/en/", "block"), (None, "/x", "block")], "host string, path string, verdict string")
    found = U.judge_urls(pages, table, rows_per_salt=rows_per_salt).collect()
    assert sorted(((r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in found), key=str) == sorted(((i, u, *brute(u, rules)) for i, u in rows), key=str)


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert U.judge_urls(pages, rules).collect() == []
    one = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert [(r.rule, r.verdict) for r in U.judge_urls(one, rules, default="block").collect()] == [(None, "block")]


def test_only_hot_hosts_are_salted(spark):
    urls = spark.createDataFrame([(["com", "a.com"],)] * 25 + [(["org", "b.org"],)] * 3, "hosts array<string>")
    rules = spark.createDataFrame([("COM", "/", "block"), ("b.org", "/", "block"), ("net", "/", "block")], "host string, path string, verdict string")
    assert {r.host: r.salts for r in U.rule_hosts(urls, rules, 10).collect()} == {"com": 3, "b.org": 1}
