import random

import pytest
from pyspark.sql import functions as F

from tamis.functions import code, gates
from tamis.functions import text as T
from tamis.operators import code_context, curation, diffs, grid, intervals, logistic, metrics, retrieval, similarity, splits
from tamis.operators.checkpoint import checkpointed

ODD = ["", None, "a\r\nb\rc\n\n", "x\x0by\x0cz\x85w v", "  \t# c\n  f(x) \n y = 1　", "version = 3\n__version__ = '1'", "é = ñandú(x)+1", "a and b\nland\n'doc'", "=x\nx=", "\n", "pass"]


def one(spark, *columns, **values):
    return spark.range(1).select(*columns).first()


def texts(spark):
    return spark.createDataFrame(list(enumerate(ODD)), "id int, t string")


def test_text_scalars_follow_python(spark):
    rows = texts(spark).select("id", T.lines(F.col("t")).alias("lines"), T.normalise(F.col("t")).alias("norm"), T.signal_lines(F.col("t")).alias("signal")).collect()
    for r in rows:
        t = ODD[r.id] or ""
        assert r.lines == t.splitlines()
        assert r.norm == "\n".join(x.strip() for x in t.splitlines() if x.strip())
        assert r.signal == sum(map(code.is_code, t.splitlines()))


@pytest.mark.parametrize(("n", "expected"), [(0, []), (1, [(1, 1)]), (64, [(1, 64)]), (65, [(1, 64), (57, 65)]), (130, [(1, 64), (57, 120), (113, 130)])])
def test_chunks(spark, n, expected):
    df = spark.createDataFrame([("\n".join(f"f({k})" for k in range(n)),)], "t string").select(T.chunks(F.col("t")).alias("c"))
    assert [(c.start_line, c.end_line) for c in df.first().c] == expected


def test_comment_only_text_has_no_chunks_unless_it_is_short(spark):
    of = lambda n: spark.createDataFrame([("\n".join(["# c"] * n),)], "t string").select(F.size(T.chunks(F.col("t")))).first()[0]
    assert (of(130), of(1)) == (0, 1)


@pytest.mark.parametrize(("sev", "slm", "params", "up"), [(1.0, 0.0, {}, False), (0.0, 0.25, {}, True), (1.0, 0.06, {}, True), (1.0, 0.0, {"override": True}, True), (0.0, 0.9, {"override": True, "threshold": 2}, False), (0.0, 0.91, {"override": True, "threshold": 2}, True)])
def test_linear_gate(spark, sev, slm, params, up):
    assert one(spark, gates.linear_gate(F.lit(sev), F.lit(slm), **params))[0] is up


def test_strategies(spark):
    get = lambda name, sev, slm: one(spark, gates.STRATEGIES[name](F.lit(sev), F.lit(slm)))[0]
    assert [get("static_only", s, 0.0) for s in (0.0, 0.3)] == [False, True]
    assert [get("model_only", 0.0, p) for p in (0.49, 0.5)] == [False, True]
    assert get("always", 0.0, 0.0) and get("logistic", 0.0, 0.0) and not get("static_or_model", 0.0, 0.1)
    assert one(spark, gates.severity_weight(F.lit("odd")), gates.severity_weight(F.lit(None)))[:] == (0.0, 0.0)
    assert one(spark, gates.multi_label_score(F.array(F.lit(0.2), F.lit(0.5), F.lit(0.9)), 0))[0] == 0.9


def test_metrics_and_costs(spark):
    rows = spark.createDataFrame([(True, 1), (False, 0), (False, 0), (False, 1)], "p boolean, y int")
    m = metrics.gate_metrics(rows, F.col("p"), F.col("y")).first()
    assert (m.tp, m.fp, m.fn, m.tn, m.precision, m.recall, m.f1, m.escalation_rate, m.token_reduction_rate, m.cost_savings_ratio) == (1, 0, 1, 2, 1.0, 0.5, 0.6667, 0.25, 0.75, 0.735)
    assert metrics.gate_metrics(rows, F.col("p"), F.col("y"), cost_ratio=0).first().cost_savings_ratio == 0.75
    assert metrics.gate_metrics(rows, F.col("p"), F.col("y"), cost_ratio=2).first().cost_savings_ratio == 0
    empty = metrics.gate_metrics(rows.limit(0), F.col("p"), F.col("y")).first()
    assert (empty.total_samples, empty.f2, empty.token_reduction_rate) == (0, 0.0, 1.0)


def test_ranking_scores_count_ties_half(spark):
    rows = spark.createDataFrame([(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0)], "s double, y int")
    assert metrics.ranking_scores(rows, "s", "y").first()[:] == (0.875, 0.833333)
    assert metrics.ranking_scores(rows.limit(0), "s", "y").first()[:] == (None, None)


def test_ranking_in_ranges_is_one_running_sum(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, float("nan"), *(x / 40 for x in range(40))]), rng.randrange(2)) for _ in range(400)]
    df = spark.createDataFrame(rows, "s double, y int")
    key = lambda s: (s is not None, s != s, s if s is not None and s == s else 0.0)
    expected, cum = [], [0, 0]
    for k in sorted({key(s) for s, _ in rows}, reverse=True):
        at = [sum(key(s) == k and y == v for s, y in rows) for v in (1, 0)]
        cum = [a + b for a, b in zip(cum, at, strict=True)]
        expected.append((k, *at, *cum, sum(y for _, y in rows), sum(1 - y for _, y in rows)))
    for per_range in (5, 1000):
        found = [(key(r.score), *r[1:]) for r in metrics.ranking(df, "s", "y", per_range).collect()]
        assert sorted(found, reverse=True) == expected


def test_grid(spark):
    rows = spark.createDataFrame([(1.0, 0.9, 1), (0.0, 0.1, 0), (0.7, 0.8, 1), (0.0, 0.2, 0)], "sev double, slm double, y int")
    points = [(w, 1 - w, t) for w in (0.0, 0.5, 1.0) for t in (0.3, 0.7)]
    found = grid.grid_search(rows, "sev", "slm", "y", points)
    assert found.count() == 6 and len(grid.grid_points()) == 441
    assert grid.best_point(found).first()[:3] == (0.0, 1.0, 0.3)


def test_logistic_matches_gradient_descent(spark):
    rng = random.Random(3)
    rows = [(rng.random(), rng.random()) for _ in range(300)]
    data = [(a, b, int(a + 2 * b + rng.gauss(0, 0.4) > 1.4)) for a, b in rows]
    w = logistic.coefficients(spark.createDataFrame(data, "a double, b double, y int"), ["a", "b"], "y")
    import numpy as np

    x, y, v = np.array([(1, a, b) for a, b, _ in data]), np.array([y for *_, y in data]), np.zeros(3)
    for _ in range(20000):
        v -= 0.5 * (x.T @ (1 / (1 + np.exp(-x @ v)) - y) / len(y) + 0.01 * v * [0, 1, 1])
    assert np.allclose(w, v, atol=1e-4)


def test_overlap_takes_the_heaviest_then_the_first(spark):
    sample = spark.createDataFrame([("a", "f", 1, 200), ("b", "f", 300, 310), ("c", "g", 1, 9)], "sample_id string, file string, start int, end int")
    finding = spark.createDataFrame([("f", 200, 205, "INFO", 0.3, 0), ("f", 64, 64, "WARNING", 0.7, 1), ("f", 60, 70, "OTHER", 0.7, 2), ("f", 201, 299, "ERROR", 1.0, 3)], "file string, start int, end int, severity string, weight double, ord int")
    assert {r.sample_id: r.severity for r in intervals.strongest_overlap(sample, finding).collect()} == {"a": "WARNING", "b": "NONE", "c": "NONE"}


def test_splits(spark):
    rows = spark.createDataFrame([(p * 5 + k, f"p{p}", k % 2) for p in range(6) for k in range(5)], "id int, project string, label int")
    split = splits.split_by_project(rows)
    assert split.groupBy("project").agg(F.countDistinct("split").alias("n")).filter("n > 1").isEmpty()
    assert {r.split for r in split.collect()} == {"train", "validation", "test"}
    assert split.collect().sort() == splits.split_by_project(rows).collect().sort()
    with pytest.raises(ValueError, match="3 projects"):
        splits.split_by_project(rows.filter("project in ('p0', 'p1')"))
    many = spark.createDataFrame([(k, "p", k % 2) for k in range(100)], "id int, project string, label int")
    counts = {r.split: r["count"] for r in splits.split_stratified(many, "id", ["project", "label"]).groupBy("split").count().collect()}
    assert counts == {"train": 60, "validation": 20, "test": 20}
    both = splits.assign_repositories(rows.withColumn("label", (F.col("project") < "p3").cast("int")))
    assert {r.labels for r in both.groupBy("split").agg(F.countDistinct("label").alias("labels")).collect()} == {2}
    assert splits.cap(rows, "id", 20, {"label": 5}).count() <= 10


def test_greedy_pair_dedup_is_the_scan(spark):
    rng = random.Random(7)
    rows = [(k, f"t{rng.randrange(30)}", f"t{rng.randrange(30)}") for k in range(80)]
    seen, kept = set(), []
    for k, a, b in rows:
        if a not in seen and b not in seen:
            kept.append(k)
            seen |= {a, b}
    found = curation.greedy_pair_dedup(spark.createDataFrame(rows, "k int, a string, b string"), "k", "a", "b", checkpointed(spark))
    assert sorted(r.k for r in found.collect()) == kept


def test_similar_pairs_match_all_pairs(spark):
    rng = random.Random(1)
    base = [[f"w{rng.randrange(40)}" for _ in range(rng.randint(5, 40))] for _ in range(12)]
    rows = []
    for k in range(60):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(50)}"
        rows.append((k, "en", " ".join(t)))
    left, right = (spark.createDataFrame(x, "id int, lang string, text string") for x in (rows[:30], rows[30:]))
    expected = {(a, b) for a, _, s in rows[:30] for b, _, t in rows[30:] if code.token_ratio(s.split(), t.split(), 0.75) > 0.75}
    assert expected and {(r.l_id, r.r_id) for r in similarity.similar_pairs(left, right, 0.75, ["lang"]).collect()} == expected


@pytest.mark.parametrize(("a", "b", "ratio", "trivial"), [("x\ny", "x\ny", 0.0, True), ("", "", 1.0, True), ("a = b(c)", "d = e(f)", 1.0, False), ("f(1)\n# a", "f(1)\n# b", 0.5, True)])
def test_line_change(a, b, ratio, trivial):
    assert code.line_change(a, b) == (ratio, trivial)


def test_diff_lines_and_anchors(spark):
    text = "diff --git a/m.py b/m.py\n--- a/m.py\n+++ b/m.py\n@@ -10,4 +10,6 @@\n a\n+b\n+c\n d\n e\n@@ -40 +42 @@ def g():\n-x\n+y"
    df = spark.createDataFrame([(1, text), (2, text.replace("m.py", "tests/m.py")), (3, None)], "id int, diff string")
    assert sorted((r.id, r.path, r.at) for r in diffs.modified_lines(df).collect()) == [(1, "m.py", 11), (1, "m.py", 12), (1, "m.py", 42)]
    assert [(r.post_start, r.post_end, r.has_def) for r in diffs.anchors(df).filter("id = 1").collect()] == [(42, 42, True)]


def test_functions_and_spans(spark):
    source = "import os\n\ndef f(a):\n    def g():\n        return h(a)\n    return g\n\nx = 1\n"
    files = spark.createDataFrame([("a.py", source), ("bad.py", "def (")], "file string, source string")
    points = spark.createDataFrame([("a.py", 5), ("a.py", 8), ("bad.py", 1)], "file string, at int")
    assert {(r.file, r.at): (r.start_line, r.end_line, r.name) for r in code_context.enclosing_span(files, points).collect()} == {("a.py", 5): (4, 5, "g"), ("a.py", 8): (5, 8, None), ("bad.py", 1): (1, 1, None)}
    assert {r.name for r in code_context.touched_functions(files, points).collect()} == {"f", "g"}
    assert code.import_lines(source) == "import os" and code.called_names("x.y(z())") == ["y", "z"]


def test_vectors(spark):
    rows = spark.createDataFrame([(0, [0.9, 0.1]), (1, [0.1, 0.9]), (2, [0.0, 0.0])], "vec_id int, embedding array<float>")
    asked = spark.createDataFrame([(7, [0.85, 0.15])], "vec_id int, embedding array<float>")
    found = retrieval.vector_topk(rows, asked, 3).orderBy("rank").collect()
    assert [r.id for r in found] == [0, 1, 2] and found[2].similarity == 0.0
    assert retrieval.vector_topk(rows, asked.limit(0), 3).collect() == []
    store, new = (spark.createDataFrame(x, "file_hash string, name string") for x in ([("h1", "a")], [("h1", "a"), ("h1", "b"), ("h2", "c"), ("h2", "c")]))
    assert retrieval.new_rows(store, new, ["file_hash", "name"]).count() == 2


@pytest.mark.parametrize("budget", [retrieval.QUERY_BYTES, 400])
def test_vector_topk_matches_all_pairs(spark, monkeypatch, budget):
    monkeypatch.setattr(retrieval, "QUERY_BYTES", budget)
    rng = random.Random(3)
    base = [[float(rng.randrange(-3, 4)) for _ in range(5)] for _ in range(20)]
    rows = [(f"v{k}", list(rng.choice(base))) for k in range(90)] + [("short", [1.0, 2.0]), ("none", None), ("hole", [1.0, None]), (None, [1.0])]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>").repartition(3)
    good = [(i, v) for i, v in rows if i and v and None not in v]

    def cosine(a, b):
        norms = [sum(x * x for x in v) ** 0.5 for v in (a, b)]
        return round(sum(x * y for x, y in zip(a, b, strict=False)) / (norms[0] * norms[1]), 6) if all(norms) else 0.0

    expected = set()
    for q, v in good[::9]:
        near = sorted((-cosine(v, w), i) for i, w in good)[:4]
        expected |= {(q, r, i, round(0.0 - s, 6)) for r, (s, i) in enumerate(near, 1)}
    found = retrieval.vector_topk(df, df.join(spark.createDataFrame([(q,) for q, _ in good[::9]], "vec_id string"), "vec_id"), 4).collect()
    assert {(r.query_id, r.rank, r.id, round(r.similarity, 6)) for r in found} == expected
