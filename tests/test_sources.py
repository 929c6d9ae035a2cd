import json

import pytest

from tamis.sources import io
from tamis.streaming import gate


def sample(i, **more):
    return {"sample_id": i, "file_path": "a.py", "function_name": "f", "start_line": 1, "end_line": 2, "label": 1} | more


def test_manifest_round_trip_and_errors(spark, tmp_path):
    good = [{"project": "p", "git_source": {"git_url": "u"}, "samples": [sample("s1"), sample("s2", label=0)]}, {"project": "q", "local_source": {"root_path": "r"}, "samples": []}]
    (tmp_path / "m.json").write_text(json.dumps(good))
    rows = io.read_manifest(spark, str(tmp_path / "m.json"))
    assert sorted((r.project, r.sample_id, r.source_kind) for r in rows.collect()) == [("p", "s1", "git"), ("p", "s2", "git")]
    io.write_manifest(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).selectExpr("explode(samples) AS s").count() == 2
    for bad in (sample("s1", label=2), sample("s1", start_line=9), sample(None)):
        (tmp_path / "m.json").write_text(json.dumps([good[0] | {"samples": [bad]}]))
        with pytest.raises(io.InvalidManifest):
            io.read_manifest(spark, str(tmp_path / "m.json"))
    for other in ({"git_source": None}, {"local_source": {"root_path": "r"}}, {"samples": [sample("s1"), sample("s1")]}):
        (tmp_path / "m.json").write_text(json.dumps([good[0] | other]))
        with pytest.raises(io.InvalidManifest):
            io.read_manifest(spark, str(tmp_path / "m.json"))


def test_findings_samples_scores_records(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"results": [{"path": "d\\t.py", "start": {"line": 2}, "end": {"line": 5}, "extra": {"severity": "ERROR"}}, {"path": "t.py", "start": {"line": 7}, "end": {"line": 9}}]}))
    assert [tuple(r) for r in io.read_findings(spark, str(tmp_path / "f.json")).orderBy("ord").collect()] == [("d/t.py", 2, 5, "ERROR", 0), ("t.py", 7, 9, "WARNING", 1)]
    rows = spark.createDataFrame([("a", 1, "x"), (None, 0, "y")], "text string, label int, extra string")
    io.write_samples(rows, str(tmp_path / "s"))
    assert sorted(map(str, io.read_samples(spark, str(tmp_path / "s")).collect())) == sorted(map(str, rows.select("text", "label").collect()))
    calls = []
    compute = lambda: calls.append(1) or rows
    for force, n in ((False, 1), (False, 1), (True, 2)):
        assert io.cached_scores(spark, str(tmp_path / "c"), compute, force).count() == 2 and len(calls) == n
    assert sorted(map(str, io.from_record_json(io.record_json(rows), "text string, label int, extra string").collect())) == sorted(map(str, rows.collect()))


def test_sources_and_store(spark, tmp_path):
    for name in ("a.py", "pkg/b.py", "tests/c.py", "d.txt"):
        (tmp_path / "r" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / name).write_text(f"# {name}\n")
    assert sorted(r.file for r in io.read_sources(spark, str(tmp_path / "r")).collect()) == ["a.py", "pkg/b.py"]
    rows = spark.createDataFrame([("h1", "f", 1), ("h1", "g", 5)], "file_hash string, function_name string, start_line int")
    for _ in range(2):
        io.append_embeddings(str(tmp_path / "e"), rows)
    assert spark.read.parquet(str(tmp_path / "e")).count() == 2


def test_streaming_gate(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2026-01-01 00:10:00' + make_interval(0, 0, 0, 0, id, 0, 0) AS ts, IF(id % 2 = 0, 'ERROR', 'NONE') AS severity, id / 10.0D AS slm_score FROM range(5)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = gate.escalations_by_window(gate.gated(stream)).writeStream.format("memory").queryName("windows").outputMode("complete").start()
    try:
        q.processAllAvailable()
        found = spark.sql("SELECT * FROM windows ORDER BY start").collect()
    finally:
        q.stop()
    assert [(r.n, r.escalated) for r in found] == [(1, 0), (1, 0), (1, 1), (1, 1), (1, 1)]
