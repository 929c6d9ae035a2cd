import hashlib
import random

import pytest

from tamis.llm import suffix_dedup as S
from tamis.llm.queries import queries


def brute(docs, length):
    starts = {}
    raw = [(i, (t or "").encode()) for i, t in docs]
    for _, b in raw:
        for k in range(len(b) - length + 1):
            starts[b[k : k + length]] = starts.get(b[k : k + length], 0) + 1
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if starts[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        runs = len([x for x in bytes(gone).split(b"\0") if x])
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(11)
    text = lambda n, letters="abcdé ": "".join(rng.choice(letters) for _ in range(n))
    shared = [text(n) for n in (39, 40, 41, 55, 90, 300)]
    rows = [(k, text(rng.randint(0, 200)) + rng.choice(shared) + text(rng.randint(0, 100)) + (rng.choice(shared) if k % 3 else "")) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "z" * 500), (103, "xy" * 30), (104, rows[0][1]), (104, rows[0][1]), (105, text(20)), (None, rows[1][1]), (106, "q" * 39), (107, "r" * 40), (108, "s" * 41), (109, text(20_000))]
    return rows


@pytest.mark.parametrize("chunk_bytes", [700, S.CHUNK_BYTES])
def test_matches_brute_force(spark, docs, chunk_bytes):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, chunk int")
    found = S.digest(S.find_repeats(d, length=40, chunk_bytes=chunk_bytes)).collect()
    assert sorted(map(tuple, found), key=str) == brute(docs, 40)


def test_shuffled_answers_equal_broadcast_ones(spark, docs, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_BYTES", -1)
    found = S.digest(S.find_repeats(spark.createDataFrame(docs, "doc_id long, text string"), length=40, chunk_bytes=700)).collect()
    assert sorted(map(tuple, found), key=str) == brute(docs, 40)


def test_texts_are_not_shuffled_where_answers_are_many(spark, docs, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_BYTES", 2_000)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    found = S.find_repeats(d, length=40, chunk_bytes=700)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") > 2 and "SortMergeJoin" not in plan
    assert sorted(map(tuple, S.digest(found).collect()), key=str) == brute(docs, 40)


def test_query_catches_passages_of_400_bytes_and_keeps_shorter_ones(spark, tmp_path):
    rng = random.Random(5)
    words = lambda n, size: " ".join("".join(rng.choice("abcdefghij") for _ in range(size)) for _ in range(n))
    passages = {"caught": words(55, 7), "short": words(55, 5)}  # 439 and 329 bytes
    rows = [(k, kind, " ".join([words(rng.randint(20, 90), 6), passages.get(kind, words(55, 7)), words(40, 6)])) for k, kind in enumerate(["caught", "short", "clean"] * 5)]
    spark.createDataFrame([(k, t) for k, _, t in rows], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries()["op3_suffix_dedup"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found), key=str) == brute([(k, t) for k, _, t in rows], 400)
    kinds = {k: kind for k, kind, _ in rows}
    assert {r.doc_id for r in found if r.n_removed} == {k for k in kinds if kinds[k] == "caught"}


def test_empty_table_and_short_length(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.find_repeats(empty).collect() == []
    with pytest.raises(ValueError, match="too short"):
        S.find_repeats(empty, length=5)


@pytest.mark.parametrize("q", [2, 3, 5, 7, 11, 13])
def test_cover_reaches_every_shift(q):
    v, cover = S.difference_cover(q)
    assert len(cover) == q + 1
    for shift in range(v):
        assert any((a + shift) % v in cover for a in cover)
