"""Lookups, nested scores, generated code rows, readers of labelled files: small cases against what they must give."""

import difflib
import json

import pytest
from pyspark.sql import functions as F

from tamis.functions import code
from tamis.functions import text as T
from tamis.operators import code_context, converters, retrieval, similarity
from tamis.sources import io


def test_commit_falls_back_in_order(spark):
    names = "id int, vulnerable_code string, fixed_code string, repo_url string, hash string, commit_id string, commit_hash string, commit_sha string, cve_id string, cwe_id string, cvss3_base_score double, cvss2_base_score double, language string, lang string, diff_with_context string"
    base = ("x = f()", "y()", "https://h/o/app.git")
    rows = [(k, *base, *("  " if j < k else f"c{j}" for j in range(4)), None, None, None, 4.3, None, None, None) for k in range(5)]
    rows += [(9, "x", " ", "https://h/o/b", *[None] * 6, None, None, None, None, None), (10, "x", "y", " ", *[None] * 6, None, None, None, None, None)]
    found = converters.fix_samples(spark.createDataFrame(rows, names), emit_fixed=True).orderBy("id", F.col("label").desc()).collect()
    assert [r.commit_id for r in found] == [c for c in ("c0", "c1", "c2", "c3", "unknown_commit") for _ in range(2)]
    assert [(r.sample_subtype, r.label) for r in found[:2]] == [("vulnerable", 1), ("fixed", 0)]
    assert found[0].target_commit is None and found[1].target_commit == "c0" and found[1].source_code == "y()" and found[0].cve_id == "unknown_cve" and found[0].cvss_score == 4.3
    assert len(converters.fix_samples(spark.createDataFrame(rows, names)).collect()) == 5


def test_signal_agrees_with_python(spark):
    lines = ["", " # x", "def f", "def f(", "def ", "if", "if x", "x = 1", "= 1", "=a += 1", "a >> b", "band", "not x", "'''q = 1", "version = 2", "call (x)", "1abc(", "(", "else", "a.b", "==", "=a in b", "pass"]
    rows = spark.createDataFrame([(x,) for x in lines], "x string").select("x", T.has_signal(F.col("x")).alias("s")).collect()
    assert {r.x: r.s for r in rows} == {x: code.is_code(x) for x in lines}


def test_points_beyond_the_file_get_its_last_line(spark):
    files = spark.createDataFrame([("a.py", "x = 1\ny = 2\n"), ("b.py", "")], "file string, source string")
    points = spark.createDataFrame([("a.py", 40), ("b.py", 3)], "file string, at int")
    found = {r.file: r.snippet for r in code_context.context_snippets(files, points).collect()}
    assert found == {"a.py": "y = 2\n", "b.py": "\n"}


def test_functions_longer_than_a_bin(spark):
    source = "def f():\n" + "    x = 1\n" * 300
    files, points = spark.createDataFrame([("a.py", source)], "file string, source string"), spark.createDataFrame([("a.py", 150), ("a.py", 250)], "file string, at int")
    assert [(r.name, r.end_line) for r in code_context.touched_functions(files, points).collect()] == [("f", 301)]
    assert {r.name for r in code_context.enclosing_span(files, points).collect()} == {"f"}


def test_nested_scores_meet_by_key(spark):
    meta = spark.createDataFrame([(1, 0, 5), (1, 1, 9), (2, 0, 3)], "doc_id int, chunk_index int, end_line int")
    scores = spark.createDataFrame([(1, 1, 0.25), (1, 0, 0.123456)], "doc_id int, chunk_index int, prob double")
    found = {r.doc_id: (r.score, [(c.chunk_index, c.end_line, c.prob) for c in r.chunks]) for r in retrieval.nested_scores(meta, scores, ["doc_id"]).collect()}
    assert found == {1: (0.25, [(0, 5, 0.1235), (1, 9, 0.25)]), 2: (None, [(0, 3, None)])}


def test_suffix_match_takes_the_first(spark):
    cases, findings = spark.createDataFrame([("x/a.py",), ("no.py",)], "expected string"), spark.createDataFrame([(2, "r/x/a.py"), (1, "y/a.py"), (3, "x/a.py")], "ord int, path string")
    assert [tuple(r) for r in retrieval.match_by_suffix(cases, findings).collect()] == [("x/a.py", 2, "r/x/a.py")]


def test_max_similarity_against_brute_force(spark):
    left = [(k, " ".join(f"w{(k * 7 + j) % 40}" for j in range(30))) for k in range(12)]
    right = [(100 + k, " ".join(f"w{(k * 3 + j) % 40}" for j in range(28))) for k in range(12)]
    found = {r.id: r.similarity for r in similarity.max_similarity(*(spark.createDataFrame(x, "id int, text string") for x in (left, right)), 0.75).collect()}
    for i, a in left:
        best = max(difflib.SequenceMatcher(None, a.split(), b.split()).ratio() for _, b in right)
        assert found[i] == pytest.approx(best if best > 0.75 else 0.0)


def test_short_items_are_found_too(spark):
    docs = spark.createDataFrame([(1, "abcdefghij" * 5), (2, "xyz"), (3, ""), (4, None)], "doc_id int, text string")
    items = spark.createDataFrame([("one", "x"), ("few", "cdefg"), ("mid", "fghijabcdefghij"), ("long", "abcdefghij" * 4), ("none", "zq"), ("empty", "")], "item_id string, item string")
    assert sorted(tuple(r) for r in similarity.contained(docs, items).collect()) == [(1, "few"), (1, "long"), (1, "mid"), (2, "one")]


def test_labelled_files(spark, tmp_path):
    for name, text in (("vul/sql/a.py", "x\ny\n"), ("safe/other/b.py", "z")):
        (tmp_path / name).parent.mkdir(parents=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "c.txt").write_text("not read")
    found = {r.file.rsplit("/", 1)[1]: (r.raw_lines, r.label, r.type) for r in io.read_labelled_files(spark, str(tmp_path)).collect()}
    assert found == {"a.py": (["x", "y"], [1, 1], ["sql", "sql"]), "b.py": (["z"], [0], ["unknown"])}
    assert [r.raw_lines for r in io.read_labelled_files(spark, str(tmp_path / "safe")).collect()] == [["z"]]


def test_evaluation_files_and_first_table(spark, tmp_path):
    summary = spark.createDataFrame([("or", 0.5), ("and", 0.25)], "variant string, f2 double")
    io.write_evaluation(summary, summary, str(tmp_path / "out"))
    assert sorted(json.loads(r.value)["f2"] for r in spark.read.text(str(tmp_path / "out/summary")).collect()) == [0.25, 0.5]
    assert "| or | 0.5 |" in [r.value for r in spark.read.text(str(tmp_path / "out/report")).collect()]
    summary.write.parquet(str(tmp_path / "t"))
    assert io.read_first(spark, [str(tmp_path / "none"), str(tmp_path / "t")]).count() == 2
    with pytest.raises(FileNotFoundError):
        io.read_first(spark, [str(tmp_path / "none")])
