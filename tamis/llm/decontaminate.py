"""Benchmark decontamination by a prefix-filtered set join with exact verification.

A window is 13 consecutive words of a benchmark item (an item of fewer words, but not none, is one window). A window
stands in a document only if all its words do, so the necessary prefix of a window, its words ordered by rarity over
all documents, is its rarest word. The windows are indexed by that word; a document word that is in the index is a
candidate at the window's offset, if the window fits between the document's ends there (length and position bounds),
and is verified word by word. Words of the document inside a verified window are hit.

Words are runs of A-Z (lower-cased), 0-9 and non-ASCII characters. A null or empty text has no words and no hits.
Repeated items and item ids count once; items with a null id hit words but are not listed; repeated documents stay
repeated.

The benchmark is read in blocks of at most `block_bytes` of text (dealt by a hash of the item), one index each;
an index of that bounded size is broadcast, and the spans of further blocks are merged by (id, text digest).
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import materialize

WINDOW = 13
#: Benchmark text that one broadcast index holds.
BLOCK_BYTES = 8_000_000

_KEEP = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEEP else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


Index = dict[bytes, list[tuple[int, int, dict[tuple[bytes, ...], tuple[str, ...]]]]]


def windows_of(items: list[tuple[str | None, str | None]], size: int = WINDOW) -> dict[tuple[bytes, ...], tuple[str, ...]]:
    """The items' windows, each with the ids of the items that hold it."""
    found: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - size + 1) if words else 0):
            found[tuple(words[i : i + size])].update(() if item is None else (item,))
    return {w: tuple(sorted(ids)) for w, ids in found.items()}


def build_index(windows: dict[tuple[bytes, ...], tuple[str, ...]], counts: dict[bytes, int]) -> Index:
    """Rarest word -> (offset, length, windows that have the word there). Ties: the word, then its first place."""
    grouped: dict[bytes, dict[tuple[int, int], dict]] = defaultdict(lambda: defaultdict(dict))
    for window, ids in windows.items():
        word = min(window, key=lambda w: (counts.get(w, 0), w))
        grouped[word][window.index(word), len(window)][window] = ids
    return {word: [(o, n, by) for (o, n), by in places.items()] for word, places in grouped.items()}


def find_spans(words: list[bytes], index: Index) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged spans [start, end) of hit words, and the ids of the items found."""
    found, items = [], set()
    for i in [i for i, w in enumerate(words) if w in index]:
        for offset, n, windows in index[words[i]]:
            start = i - offset
            if start >= 0 and start + n <= len(words) and (ids := windows.get(tuple(words[start : start + n]))) is not None:
                found.append((start, start + n))
                items.update(ids)
    return merge_spans(found), items


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def vocabulary_counts(docs: DataFrame, vocabulary: set[bytes], text_col: str) -> dict[bytes, int]:
    """How often the words of `vocabulary` stand in all documents: counted per task, then summed."""
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[bytes] = Counter()
        known = shared.value
        for batch in batches:
            for text in batch["text"]:
                total.update(filter(known.__contains__, words_of(text)))
        yield pd.DataFrame({"word": list(total), "n": list(total.values())})

    rows = docs.select(F.col(text_col).alias("text")).mapInPandas(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # a row per benchmark word at most
    return {bytes(r.word): r.n for r in rows}


def _probe(docs: DataFrame, index: Index, id_col: str, text_col: str, hits_only: bool) -> DataFrame:
    """(id, digest, n_words, spans, items); with `hits_only` the rows with hits."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            out = []
            for text in batch:
                words = words_of(text)
                spans, items = find_spans(words, known)
                out.append((len(words), [{"s": s, "e": e} for s, e in spans], sorted(items)))
            yield pd.DataFrame(out, columns=["n_words", "spans", "items"])

    found = F.pandas_udf(run, "n_words long, spans array<struct<s:long,e:long>>, items array<string>").asNondeterministic()
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)) if hits_only else F.lit(None).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), digest.alias("digest"), found(F.col(text_col)).alias("f")).select("id", "digest", "f.*")
    return rows.filter(F.size("spans") > 0) if hits_only else rows


def block_indexes(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, size: int, block_bytes: int) -> list[Index]:
    """One index per block of the benchmark."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).filter(F.col("text").isNotNull())
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    out = []
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()  # a block of bounded size
        windows = windows_of([(r.item, r.text) for r in rows], size)
        out.append(build_index(windows, vocabulary_counts(docs, {w for x in windows for w in x}, text_col) if windows else {}))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_words, spans, items) of every row of `docs`; spans are merged word ranges [s, e)."""
    indexes = block_indexes(docs, benchmark, text_col, item_col, item_text_col, size, block_bytes)
    blocks = len(indexes)
    parts = [_probe(docs, index, id_col, text_col, hits_only=blocks > 1) for index in indexes]
    if blocks == 1:
        return parts[0].drop("digest").withColumnRenamed("id", id_col)
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    hits = materialize(hits.distinct(), "contamination")
    merged = hits.groupBy("id", "digest").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    step = lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["e"] >= x["s"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["s"].alias("s"), F.greatest(F.element_at(acc, -1)["e"], x["e"]).alias("e"))))).otherwise(F.concat(acc, F.array(x)))
    merged = merged.withColumn("spans", F.aggregate(F.array_sort("spans"), F.expr("cast(array() as array<struct<s:bigint,e:bigint>>)"), step))
    counted = _with_words(docs, id_col, text_col)
    return counted.join(merged, counted["id"].eqNullSafe(merged["id"]) & (counted["digest"] == merged["digest"]), "left").select(
        counted["id"].alias(id_col), "n_words", F.coalesce("spans", F.expr("cast(array() as array<struct<s:bigint,e:bigint>>)")).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items")
    )


def _with_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, n_words) of every row."""

    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: len(words_of(t))).astype("int64")

    n_words = F.pandas_udf(count, "long").asNondeterministic()
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return plain.select("id", F.unhex(F.sha2("text", 256)).alias("digest"), n_words("text").alias("n_words"))


def n_hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])


def contaminated() -> Column:
    return (n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    return found.select(
        id_col, "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs` that are not contaminated, with its columns: judged where they are read if the benchmark is
    one block, else the contaminated texts, by digest, are taken out by an anti-join."""
    indexes = block_indexes(docs, benchmark, text_col, item_col, item_text_col, size, block_bytes)
    if len(indexes) == 1:
        shared = docs.sparkSession.sparkContext.broadcast(indexes[0])

        def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in texts:
                yield batch.map(lambda t: not _is_contaminated(words_of(t), shared.value)).astype(bool)

        return docs.filter(F.pandas_udf(clean, "boolean").asNondeterministic()(F.coalesce(F.col(text_col), F.lit(""))))
    digests = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    texts = docs.select(digests.alias("_digest"), F.col(text_col).alias("_text"))
    bad = find_contamination(texts, benchmark, "_digest", "_text", item_col, item_text_col, size, block_bytes).filter(contaminated()).select("_digest").distinct()
    return docs.select(F.struct("*").alias("_row"), digests.alias("_digest")).join(bad, "_digest", "left_anti").select("_row.*")


def _is_contaminated(words: list[bytes], index: Index) -> bool:
    hit = sum(e - s for s, e in find_spans(words, index)[0])
    return hit > 0 and 20 * hit >= len(words)
