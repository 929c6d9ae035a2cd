"""Vector top-k, one-hop context and the embedding store."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.operators.checkpoint import checkpointed

#: Bytes of query vectors that are sent to the executors at a time, and queries that meet a batch of rows at a time.
QUERY_BYTES = 32_000_000
QUERY_TILE = 256


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """One unit row per vector, padded with zeros; a zero vector stays zero."""
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def _nearest(store: DataFrame, asked: list, width: int, k: int, schema: str) -> DataFrame:
    """Per task, the k nearest rows of each asked query; ties go to the lesser id."""
    sent = store.sparkSession.sparkContext.broadcast(([r.id for r in asked], _matrix(pd.Series([r.v for r in asked]), width)))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, queries = sent.value
        best: list[list[tuple]] = [[] for _ in names]  # (-similarity, id), the nearest first
        for batch in batches:
            batch = batch.sort_values("id", kind="stable")
            ids, rows = batch["id"].tolist(), _matrix(batch["v"], width).T
            for at in range(0, len(names), QUERY_TILE):
                far = -np.round(queries[at : at + QUERY_TILE] @ rows, 6)
                for q, near in enumerate(np.argsort(far, axis=1, kind="stable")[:, :k], at):
                    best[q] = sorted(best[q] + [(far[q - at, j], ids[j]) for j in near])[:k]
        found = [(n, i, 0.0 - far) for n, b in zip(names, best, strict=True) for far, i in b]
        yield pd.DataFrame(found, columns=["query_id", "id", "similarity"])

    return store.mapInPandas(search, schema)


def vector_topk(store: DataFrame, queries: DataFrame, k: int = 2, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, id, similarity): the k nearest of every query (id, vector) by cosine to six decimals, ties by id.
    A zero vector has similarity 0 to all. Rows without id, vector or one of its numbers are neither asked nor found.

    Each group of about QUERY_BYTES of queries meets every stored row once, as products of matrices, and each task sends
    its k nearest per query on. Further groups are searched one after another, so that driver and executors hold one."""
    spark = store.sparkSession
    whole = lambda df: df.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).filter(F.col("id").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    asked, rows = whole(queries), whole(store)
    kinds = [df.schema["id"].dataType.simpleString() for df in (asked, rows)]
    schema = f"query_id {kinds[0]}, id {kinds[1]}, similarity double"
    n, width = asked.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    width = max(width or 0, rows.agg(F.max(F.size("v"))).first()[0] or 0)
    groups = max(1, -(-n * width * 8 // QUERY_BYTES))
    of = F.pmod(F.xxhash64("id"), F.lit(groups))
    keep = checkpointed(spark) if groups > 1 else lambda df: df
    found = [keep(_nearest(rows, asked.filter(of == g).collect(), width, k, schema)) for g in range(groups)]
    every = reduce(DataFrame.unionByName, found)
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")
    return every.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "similarity")


def one_hop(blocks: DataFrame, name: str = "name", out: str = "calls_out", inn: str = "calls_in") -> DataFrame:
    """(name, other, relation): the blocks that each block calls or is called by; a caller wins where both hold."""
    edges = blocks.select(name, F.explode(F.array_union(out, inn)).alias("other"), F.col(inn).alias("_in"))
    edges = edges.select(name, "other", F.when(F.array_contains("_in", F.col("other")), "caller").otherwise("callee").alias("relation")).distinct()
    known = blocks.select(F.col(name).alias("other")).distinct()
    return edges.join(known, "other", "left_semi").select(name, "other", "relation")


def new_rows(store: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to append: those whose non-empty keys the store lacks, the first of each."""
    fresh = rows.join(store.select(*keys).distinct(), keys, "left_anti")
    return fresh.dropDuplicates(keys)


def first_match(store: DataFrame, asked: DataFrame, keys: list[str], order: str) -> DataFrame:
    """`asked` with the least `order` of the stored rows of its keys, null if there is none."""
    return asked.join(store.groupBy(*keys).agg(F.min(order).alias(order)), keys, "left")


def match_by_suffix(cases: DataFrame, findings: DataFrame) -> DataFrame:
    """(expected, ord, path): the first finding (ord, path) whose path ends with the case's expected file name. They meet
    on the last part of both; cases that no finding matches drop out."""
    last = lambda c: F.element_at(F.split(F.col(c), "/"), -1)
    met = cases.withColumn("_last", last("expected")).join(findings.withColumn("_last", last("path")), "_last").filter(F.endswith("path", F.col("expected")))
    return met.groupBy("expected").agg(F.min(F.struct("ord", "path")).alias("m")).select("expected", "m.*")


def nested_scores(meta: DataFrame, scores: DataFrame, keys: list[str], index: str = "chunk_index") -> DataFrame:
    """Keys, score (the greatest probability) and chunks (structs in order of their index, probabilities to four
    decimals). Chunks and scores are joined by key and index; a chunk without a score has a null one."""
    rows = meta.join(scores.withColumn("prob", F.round("prob", 4)), [*keys, index], "left")
    inner = [c for c in rows.columns if c not in (*keys, index)]
    return rows.groupBy(*keys).agg(F.max("prob").alias("score"), F.array_sort(F.collect_list(F.struct(index, *inner))).alias("chunks"))


def latest(runs: DataFrame, keys: list[str], time: str, name: str) -> DataFrame:
    """The run of each key with the greatest time; of those the greatest name."""
    return runs.groupBy(*keys).agg(F.max(F.struct(time, name)).alias("m")).select(*keys, "m.*")
