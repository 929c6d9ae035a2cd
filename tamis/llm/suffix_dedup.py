"""Removal of long repeated byte strings, by names of difference-cover samples.

Every byte covered by a string of `length` bytes that also starts anywhere else (in the same document too, overlaps
count, judged on the input) is removed; a match never crosses documents.

Method. Positions whose offset modulo v lies in a perfect difference cover are sampled: any two positions have a shift
below v that takes both to sampled ones. A sampled suffix is named by a triple of its next three blocks, and the
triples' names are named again in threes, until a name stands for the w = length + 1 - v bytes that two suffixes with
an equal `length`-byte prefix must share at their common sample. All samples' names are sorted over the cluster and
neighbours compared. The remaining suffixes are merged in from there: only starts less than v before a sample whose
name repeats can begin a repeated string; those starts, sampled or not, are named by the triple of blocks that spans
their whole prefix, sorted, and compared with their neighbours again.

Names are 64-bit fingerprints and not dense ranks: equal prefixes stand side by side in any order of names, so that
recursion needs no exchange, and the order between unequal suffixes, which a suffix array would add, is not kept. Two
different strings get one name with probability 2 ** -64.

Bounds. Documents are packed into chunks of about `chunk_bytes`. A chunk sends each of its names once, in sorted runs,
to the range of names that owns it, and gets one bit a name back; a name that repeats within the chunk is known there.
So hot strings and groups of copies cost one name a chunk, every range holds about the same number of names, and
no pair of occurrences is formed. The number of ranges grows with the input. Texts are never shuffled: answers are
broadcast, for one group of neighbouring chunks after the other where they are many. A chunk needs about 40 bytes of memory per
byte, or per byte of its one document if that is longer.

Defined results: a null text is empty; texts shorter than `length` lose nothing. Repeated rows stay repeated (and lose
all their bytes if they have `length` of them). Columns other than the two named are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import materialize, scratch, shuffle_partitions

LENGTH = 400
CHUNK_BYTES = 2_000_000
#: Input bytes that one range of names answers for.
BYTES_PER_RANGE = 64_000_000
#: Answers are sent to every executor for so many chunks at a time that they have up to this size.
BROADCAST_BYTES = 32_000_000

_U = np.uint64
_BASE = _U(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)


@cache
def difference_cover(q: int) -> tuple[int, tuple[int, ...]]:
    """The perfect cover of q + 1 residues modulo v = q * q + q + 1, for a prime q: the powers of an element of the
    cubic field over GF(q) that lie in a plane. Every residue is a difference of two of them."""
    v = q * q + q + 1
    for r0 in range(1, q):
        for r1 in range(q):
            for r2 in range(q):
                a, b, c, found = 1, 0, 0, []
                for i in range(v):  # x ** 3 = r0 + r1 x + r2 x ** 2
                    if c == 0:
                        found.append(i)
                    a, b, c = c * r0 % q, (a + c * r1) % q, (b + c * r2) % q
                if len(found) == q + 1 and len({(x - y) % v for x in found for y in found}) == v:
                    return v, tuple(found)
    raise ValueError(q)


def plan(length: int) -> tuple[int, np.ndarray, int]:
    """v, which residues are sampled, and the block size of a sample's name (nine blocks)."""
    q = max((q for q in (2, 3, 5, 7, 11, 13, 17, 19) if q * q + q + 1 <= (length + 1) // 2), default=0)
    if not q or (length + 1 - (q * q + q + 1)) // 9 < 1:
        raise ValueError(f"length {length} is too short for a cover")
    v, cover = difference_cover(q)
    sampled = np.zeros(v, dtype=bool)
    sampled[list(cover)] = True
    return v, sampled, (length + 1 - v) // 9


class Names:
    """Names of byte strings of one chunk."""

    def __init__(self, buffer: np.ndarray):
        n = len(buffer)
        powers = np.full(n + 1, _BASE)
        powers[0] = 1
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[buffer] * np.cumprod(powers, dtype=np.uint64)[:n], dtype=np.uint64, out=self.sums[1:])
        powers[1:] = _U(pow(int(_BASE), -1, 1 << 64))
        self.down = np.cumprod(powers, dtype=np.uint64)

    def block(self, at: np.ndarray, size: int) -> np.ndarray:
        return _mix((self.sums[at + size] - self.sums[at]) * self.down[at])

    def triple(self, at: np.ndarray, size: int, step: int, depth: int) -> np.ndarray:
        """The name of three neighbouring strings; at depth 1 they are blocks, beyond it triples."""
        inner = (lambda p: self.block(p, size)) if depth == 1 else (lambda p: self.triple(p, size, step // 3, depth - 1))
        out = inner(at)
        for k in (1, 2):
            out = _mix(out * _U(0x9E3779B97F4A7C15) + inner(at + k * step))
        return out


def sample_starts(ends: np.ndarray, total: int, length: int) -> np.ndarray:
    """Sampled positions of a chunk whose documents end at `ends`, with room for the sample's name."""
    v, sampled, block = plan(length)
    starts = np.concatenate([[0], ends[:-1]])
    size = np.diff(np.concatenate([[0], ends]))
    at = np.arange(total)
    take = sampled[(at - np.repeat(starts, size)) % v] & (at + 9 * block <= np.repeat(ends, size))
    return np.flatnonzero(take)


def candidate_starts(hot: np.ndarray, ends: np.ndarray, total: int, length: int) -> np.ndarray:
    """Starts of `length`-byte strings less than v before a sample whose name repeats."""
    v, _, _ = plan(length)
    size = np.diff(np.concatenate([[0], ends]))
    begin = np.repeat(np.concatenate([[0], ends[:-1]]), size)
    change = np.zeros(total + 1, dtype=np.int32)
    np.add.at(change, np.maximum(hot - v + 1, begin[hot]), 1)
    np.add.at(change, hot + 1, -1)
    near = np.cumsum(change[:total]) > 0
    return np.flatnonzero(near & (np.arange(total) + length <= np.repeat(ends, size)))


def sample_names(names: Names, at: np.ndarray, length: int) -> np.ndarray:
    block = plan(length)[2]
    return names.triple(at, block, 3 * block, 2)


def prefix_names(names: Names, at: np.ndarray, length: int) -> np.ndarray:
    """Names of whole prefixes: three blocks that overlap just enough to span them."""
    size = -(-(length + 2) // 3)
    out = names.block(at, size)
    for shift in ((length - size) // 2, length - size):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + names.block(at + shift, size))
    return out


def _pack(batches: Iterator[pd.DataFrame], chunk_bytes: int) -> Iterator[pd.DataFrame]:
    """Chunks of whole documents in the order they come."""
    part = TaskContext.get().partitionId()
    seq, ids, raw, size = 0, [], [], 0

    def close() -> pd.DataFrame:
        nonlocal seq, ids, raw, size
        row = pd.DataFrame({"chunk": [(part << 32) + seq], "ids": [ids], "sizes": [[len(x) for x in raw]], "raw": [b"".join(raw)]})
        seq, ids, raw, size = seq + 1, [], [], 0
        return row

    for batch in batches:
        for i, text in zip(batch["id"], batch["text"], strict=True):
            x = (text or "").encode("utf-8", "surrogatepass")
            if raw and size + len(x) > chunk_bytes:
                yield close()
            ids.append(None if pd.isna(i) else i)
            raw.append(x)
            size += len(x)
    if raw:
        yield close()


def _repeated(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, whether each occurs twice or more, and the place of each value among them."""
    order = np.argsort(values)
    s = values[order]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    place = np.empty(len(s), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return s[at], np.diff(np.concatenate([at, [len(s)]])) > 1, place


def _owners(distinct: np.ndarray, ranges: int) -> np.ndarray:
    """Where the values of each range begin among the sorted distinct values, and their end."""
    cuts = np.array([(k << 64) // ranges for k in range(1, ranges)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(distinct, cuts), [len(distinct)]])


def _answers(row, column: str, distinct: int, ranges: int, owners: np.ndarray) -> np.ndarray:
    """One bit per distinct value: does another chunk have it?"""
    out = np.zeros(distinct, dtype=bool)
    for k, mask in zip(row[f"{column}_ranges"], row[f"{column}_masks"], strict=True):
        s, e = owners[k], owners[k + 1]
        out[s:e] = np.unpackbits(np.frombuffer(mask, np.uint8), count=e - s, bitorder="little").astype(bool)
    return out


class _Chunk:
    """One chunk's text and what is known of its names so far."""

    def __init__(self, row: dict, length: int, ranges: int):
        self.buffer = np.frombuffer(bytes(row["raw"]), dtype=np.uint8)
        self.ends, self.total = np.cumsum(np.asarray(row["sizes"], dtype=np.int64)), len(self.buffer)
        self.names, self.length, self.ranges, self.row = Names(self.buffer), length, ranges, row
        self.samples = sample_starts(self.ends, self.total, length)

    def _known(self, names: np.ndarray, column: str) -> np.ndarray:
        """Which of the names repeat anywhere, by the answers in `column`."""
        distinct, twice, place = _repeated(names)
        return (twice | _answers(self.row, column, len(distinct), self.ranges, _owners(distinct, self.ranges)))[place]

    def sample_names(self) -> np.ndarray:
        return sample_names(self.names, self.samples, self.length)

    def candidates(self) -> np.ndarray:
        hot = self.samples[self._known(self.sample_names(), "first")]
        return candidate_starts(hot, self.ends, self.total, self.length)

    def prefix_names(self, at: np.ndarray) -> np.ndarray:
        return prefix_names(self.names, at, self.length)

    def removed(self) -> np.ndarray:
        at = self.candidates()
        change = np.zeros(self.total + 1, dtype=np.int32)
        at = at[self._known(self.prefix_names(at), "second")]
        np.add.at(change, at, 1)
        np.add.at(change, at + self.length, -1)
        return np.cumsum(change[: self.total]) > 0


def _ask(names: np.ndarray, chunk: int, ranges: int) -> pd.DataFrame:
    """The chunk's distinct names, a sorted run per range."""
    distinct, _, _ = _repeated(names)
    owners = _owners(distinct, ranges)
    full = np.flatnonzero(np.diff(owners))
    return pd.DataFrame({"range": full.astype(np.int32), "chunk": np.int64(chunk), "names": [distinct[owners[k] : owners[k + 1]].astype("<u8").tobytes() for k in full]})


def _answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per range and chunk, a bit per name: whether another chunk has it. A range's names are held together."""
    held: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
    for batch in batches:
        for r in batch.itertuples(index=False):
            held[r.range].append((r.chunk, np.frombuffer(bytes(r.names), "<u8")))
    for k, runs in held.items():
        every = np.sort(np.concatenate([x for _, x in runs]))
        shared = np.unique(every[1:][every[1:] == every[:-1]])
        for chunk, x in runs:
            place = np.searchsorted(shared, x)
            hit = (place < len(shared)) & (shared[np.minimum(place, len(shared) - 1)] == x) if len(shared) else np.zeros(len(x), bool)
            yield pd.DataFrame({"chunk": [chunk], "range": [k], "mask": [np.packbits(hit, bitorder="little").tobytes()]})


def _exchange(asked: DataFrame, ranges: int) -> DataFrame:
    """(chunk, range, mask): the answers to each chunk."""
    answered = asked.repartitionById(ranges, F.col("range")).mapInPandas(_answer, "chunk long, range int, mask binary")
    return materialize(answered, "answers")


def _groups(*answered: DataFrame) -> list[tuple[int, int]]:
    """Neighbouring chunks, first and end, whose answers have BROADCAST_BYTES together. Chunks of one writing task stay
    together, so that a group's files are found by their statistics."""
    part = F.shiftright("chunk", 32).alias("part")
    every = answered[0].select(part, "mask")
    for more in answered[1:]:
        every = every.unionByName(more.select(part, "mask"))
    cuts, size = [0], 0
    for r in every.groupBy("part").agg(F.sum(F.octet_length("mask") + 24).alias("n")).orderBy("part").collect():
        if size and size + r.n > BROADCAST_BYTES:
            cuts.append(r.part << 32)
            size = 0
        size += r.n
    return list(zip(cuts, [*cuts[1:], (1 << 63) - 1], strict=True))


def _with(chunks: DataFrame, **answered: DataFrame) -> DataFrame:
    """The chunks with <column>_ranges and <column>_masks for each table of answers."""
    parts = []
    for first, end in _groups(*answered.values()):
        mine = (F.col("chunk") >= first) & (F.col("chunk") < end)
        out = chunks.filter(mine)
        for column, df in answered.items():
            both = df.filter(mine).groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("range", "mask"))).alias("a"))
            both = both.select("chunk", F.col("a.range").alias(f"{column}_ranges"), F.col("a.mask").alias(f"{column}_masks"))
            out = out.join(F.broadcast(both), "chunk", "left").withColumns({f"{column}_{k}": F.coalesce(f"{column}_{k}", F.expr(f"cast(array() as array<{kind}>)")) for k, kind in (("ranges", "int"), ("masks", "binary"))})
        parts.append(out)
    return reduce(DataFrame.unionByName, parts)


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id, n_bytes, spans, kept): removed byte ranges [s, e) and the remaining bytes of every document."""
    spark = docs.sparkSession
    plan(length)
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = plain.schema["id"].dataType.simpleString()
    path = scratch(spark, "chunks")
    schema = f"chunk long, ids array<{id_type}>, sizes array<int>, raw binary"
    plain.mapInPandas(lambda it: _pack(it, chunk_bytes), schema).write.option("compression", "zstd").parquet(path)
    chunks = spark.read.schema(schema).parquet(path)
    size = chunks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    ranges = max(shuffle_partitions(spark), -(-size // BYTES_PER_RANGE))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[_Chunk]:
        for batch in batches:
            for row in batch.to_dict("records"):
                yield _Chunk(row, length, ranges)

    def ask_samples(batches):
        for c in each(batches):
            yield _ask(c.sample_names(), c.row["chunk"], ranges)

    def ask_prefixes(batches):
        for c in each(batches):
            yield _ask(c.prefix_names(c.candidates()), c.row["chunk"], ranges)

    def finish(batches):
        for c in each(batches):
            gone, starts = c.removed(), np.concatenate([[0], c.ends[:-1]])
            out = []
            for i, s, e in zip(c.row["ids"], starts, c.ends, strict=True):
                x = gone[s:e]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], x.view(np.int8), [0]])))
                out.append((i, int(e - s), [{"s": int(a), "e": int(b)} for a, b in edge.reshape(-1, 2)], c.buffer[s:e][~x].tobytes()))
            yield pd.DataFrame(out, columns=["id", "n_bytes", "spans", "kept"])

    names = "range int, chunk long, names binary"
    first = _exchange(chunks.select("chunk", "sizes", "raw").mapInPandas(ask_samples, names), ranges)
    second = _exchange(_with(chunks.drop("ids"), first=first).mapInPandas(ask_prefixes, names), ranges)
    done = _with(chunks, first=first, second=second).mapInPandas(finish, f"id {id_type}, n_bytes long, spans array<struct<s:long,e:long>>, kept binary")
    return done.withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256)."""
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return found.select(id_col, "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


