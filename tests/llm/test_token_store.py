import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tamis.llm import token_store as T
from tamis.llm.common import scratch

FILE = T.public_file("word_bpe_49k.json")
TEXTS = ["Hello, World!", "", None, "it's <|endoftext|> don't 'tis", "a\tb  x² ñandú İstanbul ÀÉ123", "one\n\ntwo three " * 400, "é ́x Ǆ ΑΣ ÿŸ (hi) a.b c--d", "word", "word", "%%% &&& ***", "x" * 3000]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 5000), max_size=300))
def test_elias_fano_round_trip(steps):
    values = np.cumsum(steps, dtype=np.int64)
    ef = T.EliasFano.encode(values)
    assert ef.to_array().tolist() == values.tolist()
    assert [ef.select(i) for i in range(len(values))] == values.tolist()
    if len(values):
        assert len(ef.low) + len(ef.high) <= len(values) * (2 + np.log2(1 + values[-1] / len(values))) / 8 + 3
    with pytest.raises(IndexError):
        ef.select(len(values))


def test_chunks_encode_like_whole_texts():
    encoder = T.ChunkEncoder(FILE, 2)
    assert encoder.by_piece
    texts = [t or "" for t in TEXTS]
    expected = [np.array(x.ids + [2], "<u4").tobytes() for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(texts) == expected == encoder.encode(texts)
    encoder.by_piece, encoder.cache = False, T._Cache(10)
    assert encoder.encode(texts) == expected


@pytest.mark.parametrize("parts", [1, 5])
def test_store_round_trip(spark, parts):
    rows = [(7 * k % 11 if k else None, t, k) for k, t in enumerate(TEXTS)] + [(2**60 + 1, "far", 0)]
    path = scratch(spark, "test-store")
    T.write_store(spark.createDataFrame(rows, "doc_id long, text string, start int"), path, FILE, 2, parts=parts)
    found = T.read_store(spark, path).collect()
    encoder = T.ChunkEncoder(FILE, 2)
    ids = {i: encoder.encode([t or ""])[0] for i, t, _ in rows}
    at = 0
    for r in sorted(found, key=lambda r: (r.id is not None, r.id or 0)):
        assert (r.start, r.n_tokens, bytes(r.ids)) == (at, len(ids[r.id]) // 4, ids[r.id])
        at += r.n_tokens
    digests = {r.doc_id: r.ids_crc32 for r in T.digest(T.read_store(spark, path)).collect()}
    assert digests == {i: zlib.crc32(x) for i, x in ids.items()}


def test_empty_store(spark):
    path = scratch(spark, "test-empty")
    T.write_store(spark.createDataFrame([], "doc_id long, text string"), path, FILE, 2)
    assert T.read_store(spark, path).collect() == []


def test_blocks_close_by_size(spark, monkeypatch):
    import pandas as pd

    monkeypatch.setattr(T, "BLOCK_DOCS", 3)
    docs = pd.DataFrame({"part": [0] * 7 + [1] * 2, "id": range(9), "none": False, "ids": [T.pack(np.arange(k + 1, dtype="<u4").tobytes()) for k in range(9)]})
    blocks = pd.concat(list(T._blocks(iter([docs]))))
    assert blocks["n_docs"].tolist() == [3, 3, 1, 2] and blocks["base"].tolist() == [0, 6, 21, 0]


def test_string_ids_are_refused(spark, tmp_path):
    docs = spark.createDataFrame([("a", "text")], "doc_id string, text string")
    with pytest.raises(TypeError):
        T.write_store(docs, str(tmp_path / "s"), "none", 2)


def test_cache_keeps_what_returns():
    cache = T._Cache(4)
    for wanted in ({"a", "b", "c"}, {"a", "d"}, {"e", "f"}):
        new = cache.missing(wanted)
        cache.ids.update((x, x.encode()) for x in new)
    assert sorted(cache.ids) == ["a", "d", "e", "f"] and "b" in cache.old
    assert sorted(cache.missing({"a", "b", "g"})) == ["b", "g"]


def test_a_small_cache_encodes_alike():
    texts = [" ".join(f"w{k * n % 97}!" for k in range(60)) for n in range(1, 40)] + ["", " ", "\n\n", "a  b"]
    small, large = T.ChunkEncoder(FILE, 2, 10), T.ChunkEncoder(FILE, 2)
    assert [small.encode([t])[0] for t in texts] == large.encode(texts) and large.encode([]) == []
