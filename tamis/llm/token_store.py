"""Token ids in binary blocks with Elias-Fano document boundaries.

A store is a folder with two Parquet tables. `blocks` holds one row per block of consecutive documents: the ids as
little-endian words of 2 or 4 bytes (`width`), the documents' ids (the first
`n_null` are null) and their end offsets as an Elias-Fano sequence: `low` has the
l low bits of each offset, `high` the unary-coded upper halves, `sel` the position of every 64th set bit of `high`,
from which a select walks less than one word of documents. `manifest` holds one row per part with the number of ids
that stand before it. Offsets in a block are relative to it, so that no table of 64-bit offsets is kept.

Documents stand in ascending id order (nulls first; rows with the same id by their ids' bytes). A null text is empty.
Every document ends with `end_id`. An empty table gives an empty store. Ids are integers; a table with
ids of another type is refused with a TypeError. Columns other than the two named are not read.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tamis.llm.common import shuffle_partitions

#: A block closes with the document that reaches either number.
BLOCK_IDS, BLOCK_DOCS = 1 << 20, 1 << 13
#: Chunks of text, or pieces of such, whose ids a worker keeps.
CACHE_CHUNKS = 250_000
SELECT_EVERY = 64


def public_file(name: str) -> str:
    """The place of a file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


class EliasFano:
    """A non-decreasing sequence of n integers up to u in n * (2 + log2(u / n)) bits and select samples."""

    def __init__(self, n: int, l: int, low: bytes, high: bytes, sel: bytes):  # noqa: E741
        self.n, self.l, self.low, self.high, self.sel = n, l, low, high, sel

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.int64)
        n = len(v)
        if not n:
            return cls(0, 0, b"", b"", b"")
        l = max(0, int(v[-1] // n).bit_length() - 1)  # noqa: E741
        bits = ((v[:, None] >> np.arange(l)) & 1).astype(np.uint8)
        ones = (v >> l) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1, dtype=np.uint8)
        high[ones] = 1
        return cls(n, l, np.packbits(bits.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::SELECT_EVERY].astype("<u4").tobytes())

    def _low(self, i: int) -> int:
        at, out = i * self.l, 0
        for k in range(self.l):
            out |= ((self.low[(at + k) >> 3] >> ((at + k) & 7)) & 1) << k
        return out

    def select(self, i: int) -> int:
        """The i-th value: jump to the sample before it, then count set bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(np.frombuffer(self.sel, "<u4")[i // SELECT_EVERY])
        left = i % SELECT_EVERY
        byte, word = at >> 3, self.high[at >> 3] >> (at & 7)
        base = at
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            base, word = byte << 3, self.high[byte]
        while left or not word & 1:
            left -= word & 1
            word >>= 1
            base += 1
        return ((base - i) << self.l) | self._low(i)

    def to_array(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0, dtype=np.int64)
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        upper = (ones - np.arange(self.n)).astype(np.int64) << self.l
        if not self.l:
            return upper
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.l].reshape(self.n, self.l)
        return upper | (bits.astype(np.int64) << np.arange(self.l)).sum(axis=1)


# The pre-tokenizer pattern for which a word and the marks behind it are pieces of their own.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters that lower-case alike everywhere, and ASCII marks without the apostrophe.
_LETTERS, _MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]+", r"[!-&(-/:-@\[-`{-~]+"
_WORD, _WORD_AND_MARKS = f"^{_LETTERS}({_MARKS})?$", f"^({_LETTERS})({_MARKS})$"
_PIECE = re.compile(f"(?:{_LETTERS}|{_MARKS})\\Z")


def _gather(ids: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of `ids` that start at `begin` and have `size` items, one after another."""
    shift = begin - (np.cumsum(size) - size)
    return ids[np.repeat(shift, size) + np.arange(size.sum())]


class _Cache:
    """Ids by text, about `most` of them: once half as many are new, those of the half before that were not asked for go."""

    def __init__(self, most: int):
        self.most = most
        self.ids: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, wanted: set[str]) -> list[str]:
        """Which of `wanted` are to be added to `ids`; the others will be there."""
        if len(self.ids) > self.most // 2:
            self.old, self.ids = self.ids, {}
        absent = wanted.difference(self.ids)
        back = absent.intersection(self.old)
        self.ids.update((x, self.old[x]) for x in back)
        return list(absent - back)


class ChunkEncoder:
    """Ids of whole texts, by a cache of the ids of their chunks between blanks and line feeds.

    Only for tokenizers that never join text across white space; `encode` gives what the tokenizer gives for the text.
    Where the tokenizer lower-cases, splits words from marks and ends each piece with a token of its own kind, chunks
    are taken apart into pieces, the cache holds pieces, and many new ones are encoded as one text. Chunks and pieces
    are found by Arrow: only the distinct ones of a call become Python strings."""

    def __init__(self, file: str, end_id: int, cache_chunks: int = CACHE_CHUNKS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(file), np.array([end_id], "<u4").tobytes()
        self.cache = _Cache(cache_chunks)
        spec = json.loads(self.tokenizer.to_str())
        suffix = spec["model"].get("end_of_word_suffix")
        self.by_piece = bool(suffix) and _PIECES in json.dumps(spec["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\") and '"Lowercase"' in json.dumps(spec["normalizer"])
        if self.by_piece:
            vocab = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
            self.ends[[i for token, i in vocab.items() if token.endswith(suffix)]] = True

    def _encode_all(self, parts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _add_pieces(self, new: list[str], together: int = 64) -> None:
        groups = [new[at : at + together] for at in range(0, len(new), together)]
        for group, found in zip(groups, self._encode_all([" ".join(g) for g in groups]), strict=True):
            ids = np.frombuffer(found, "<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(ends) == len(group) and ends[-1] == len(found):
                self.cache.ids.update(zip(group, (found[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)), strict=True))
            else:
                self.cache.ids.update(zip(group, self._encode_all(group), strict=True))

    def _ids(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct strings, one after another, and how many each has."""
        names = names.to_numpy(zero_copy_only=False).tolist()
        new = self.cache.missing(set(names))
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            pieces = [x for x in some if _PIECE.match(x)] if self.by_piece else []
            self._add_pieces(pieces)
            rest = list(set(some).difference(pieces))
            self.cache.ids.update(zip(rest, self._encode_all(rest), strict=True))
        found = list(map(self.cache.ids.__getitem__, names))
        return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def _chunk_ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_piece:
            return self._ids(chunks)
        chunks = pc.if_else(pc.match_substring_regex(chunks, _WORD), pc.utf8_lower(chunks), chunks)
        apart = pc.split_pattern(pc.replace_substring_regex(chunks, _WORD_AND_MARKS, r"\1 \2"), " ")
        pieces = apart.flatten().dictionary_encode()
        ids, size = self._ids(pieces.dictionary)
        codes = pieces.indices.to_numpy()
        each = size[codes]
        ends = np.concatenate([[0], np.cumsum(each)])[apart.offsets.to_numpy()]
        return _gather(ids, (np.cumsum(size) - size)[codes], each), np.diff(ends)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, with the end id."""
        if not texts:
            return []
        split = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        chunks = split.flatten().dictionary_encode()
        ids, size = self._chunk_ids(chunks.dictionary)
        codes = chunks.indices.to_numpy()
        each = size[codes]
        every = _gather(ids, (np.cumsum(size) - size)[codes], each)
        cuts = np.concatenate([[0], np.cumsum(each)])[split.offsets.to_numpy()]
        return [every[s:e].tobytes() + self.end for s, e in zip(cuts[:-1], cuts[1:], strict=True)]


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def _encoder(file: str, end_id: int) -> ChunkEncoder:
    """One per worker process: workers live over many tasks."""
    if (key := (file, end_id)) not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(file, end_id)
    return _ENCODERS[key]


def _text_slices(texts: list[str], most: int = 2_000_000) -> Iterator[slice]:
    """Slices of about `most` characters, so that a batch's working memory stays bounded."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    yield slice(start, len(texts))


def tokenize(docs: DataFrame, tokenizer_file: str, end_id: int, splits: list[int], id_col: str, text_col: str) -> DataFrame:
    """(part, id, ids): part by the place of the id among `splits`."""
    cuts = np.array(splits, dtype=np.int64)

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(tokenizer_file, end_id)
        for ids, column in batches:
            texts = [t or "" for t in column]
            part = np.searchsorted(cuts, ids.to_numpy(np.int64), side="left").astype(np.int32)
            packed = [pack(x) for s in _text_slices(texts) for x in encoder.encode(texts[s])] if texts else []
            yield pd.DataFrame({"part": part, "ids": packed})

    encoded = F.pandas_udf(run, "part int, ids binary").asNondeterministic()
    id_ = F.col(id_col).cast("long")
    lowest = F.coalesce(id_, F.lit(-(1 << 63)))  # nulls stand first
    return docs.select(id_.alias("id"), encoded(lowest, F.col(text_col)).alias("e")).select("e.part", "id", "e.ids")


def pack(ids: bytes) -> bytes:
    """Width byte and ids: 2 bytes an id where they fit, else 4."""
    a = np.frombuffer(ids, "<u4")
    return b"\2" + a.astype("<u2").tobytes() if not len(a) or a.max() < 1 << 16 else b"\4" + ids


def unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u2" if packed[0] == 2 else "<u4", offset=1).astype("<u4")


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of the documents as they come, sorted; `base` is the ids before it in its part."""
    part, seq, base, ids, packed, size = None, 0, 0, [], [], 0

    def close() -> pd.DataFrame:
        nonlocal seq, base, ids, packed, size
        arrays = [unpack(p) for p in packed]
        ends = EliasFano.encode(np.cumsum([len(a) for a in arrays]))
        every = np.concatenate(arrays)
        width = 2 if every.max() < 1 << 16 else 4
        row = {"part": part, "seq": seq, "base": base, "n_docs": len(ids), "n_ids": len(every), "width": width, "n_null": ids.count(None), "doc_ids": np.array([i or 0 for i in ids], dtype="<i8").tobytes(), "low_bits": ends.l, "low": ends.low, "high": ends.high, "sel": ends.sel, "ids": every.astype(f"<u{width}").tobytes()}
        seq, base, ids, packed, size = seq + 1, base + len(every), [], [], 0
        return pd.DataFrame([row])

    for batch in batches:
        for p, i, none, x in zip(batch["part"], batch["id"], batch["none"], batch["ids"], strict=True):
            if ids and (p != part or size >= BLOCK_IDS or len(ids) >= BLOCK_DOCS):
                yield close()
            if p != part:
                part, seq, base = p, 0, 0
            ids.append(None if none else int(i))
            packed.append(x)
            size += (len(x) - 1) // x[0]
    if ids:
        yield close()


_BLOCK_SCHEMA = "part int, seq int, base long, n_docs int, n_ids long, width int, n_null int, doc_ids binary, low_bits int, low binary, high binary, sel binary, ids binary"


def write_store(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> None:
    """Tokenize whole texts and write the store. One shuffle, of ids, to parts of consecutive documents."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{id_col} must hold integers, not {kind.simpleString()}")
    parts = parts or shuffle_partitions(spark)
    cuts = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), [(k + 1) / parts for k in range(parts - 1)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted(set(cuts)) if parts > 1 else []
    tokens = tokenize(docs, tokenizer_file, end_id, cuts, id_col, text_col)
    placed = tokens.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", F.col("id").asc_nulls_first(), "ids")
    placed = placed.select("part", F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().alias("none"), "ids")  # without nulls pandas keeps integers
    placed.mapInPandas(_blocks, _BLOCK_SCHEMA).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/blocks")
    sums = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n_ids"), F.sum("n_docs").alias("n_docs"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums.select("part", "n_ids", "n_docs", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start")).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for b in batch.itertuples(index=False):
            ends = EliasFano(b.n_docs, b.low_bits, b.low, b.high, b.sel).to_array()
            ids = np.frombuffer(b.ids, f"<u{b.width}").astype("<u4")
            starts = np.concatenate([[0], ends[:-1]])
            yield pd.DataFrame({
                "id": pd.arrays.IntegerArray(np.frombuffer(b.doc_ids, "<i8").astype(np.int64), np.arange(b.n_docs) < b.n_null), "start": b.start + b.base + starts, "n_tokens": ends - starts,
                "ids": [ids[s:e].tobytes() for s, e in zip(starts, ends, strict=True)],
            })


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids): one row per document, ids as little-endian unsigned 32-bit integers."""
    starts = F.broadcast(spark.read.parquet(f"{path}/manifest").select("part", "start"))  # a row per part
    return spark.read.parquet(f"{path}/blocks").join(starts, "part").mapInPandas(_documents, "id long, start long, n_tokens long, ids binary")


def digest(store: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32)."""
    return store.select(F.col("id").alias(id_col), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


