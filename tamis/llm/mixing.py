"""Mixing sources to target weights by iterative proportional fitting (DataFrame functions only).

Documents fall into cells of (source, language, topic). The cells' expected sampled tokens start at `fraction` of their
tokens and are raked: scaled in turn so that the sums by source, by language and by topic meet their targets, and cut at
the tokens that a cell has, so that what one cell cannot give the others of its row give in the next round. After a
fixed number of rounds a cell's sampling probability is its raked tokens over its tokens, never above 1. The targets
default to tempered shares, (tokens ** temperature) normalised, and can be given per value. Targets that the tokens
cannot meet are missed; `residuals` reports target and expected share of every value.

Tokens are white-space separated words of the whole text. Null texts have none; null sources, languages and topics
count as the empty string; a document in a cell without tokens is sampled with probability 1. Values
with a target but no tokens are left out and the rest is rescaled. Repeated rows share one fate. Documents keep all
their columns.

Only cells meet in one place. Up to `SMALL_CELLS` of them are raked in one partition and broadcast back; beyond that
the same windows and the join run shuffled, and Spark splits the skewed side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.common import discard, materialize

SMALL_CELLS = 50_000
ROUNDS, ROUNDS_PER_JOB = 20, 4
KEYS = ("source", "lang", "topic")
#: A cell's probability has this many decimals.
DECIMALS = 9


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def form_topic(bars: Column, tokens: Column) -> Column:
    """The topic where the documents carry none: the form of the text, by its bars and its tokens."""
    return F.when(5 * bars > tokens, "table").when(tokens < 100, "note").when(tokens < 1000, "article").otherwise("long")


def uniform(id_: Column) -> Column:
    """A number in [0, 1) from the id's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(id_.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def with_cells(docs: DataFrame, text_col: str = "text", topic: Column | None = None) -> DataFrame:
    """_row, a struct of the columns of `docs`, and _source, _lang, _topic, _tokens beside it."""
    tokens, text = token_count(F.col(text_col)), F.coalesce(F.col(text_col), F.lit(""))
    named = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_{k}") for k in ("source", "lang")]
    if topic is not None:
        return docs.select(F.struct("*").alias("_row"), *named, F.coalesce(topic.cast("string"), F.lit("")).alias("_topic"), tokens.alias("_tokens"))
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    plain = docs.select(F.struct("*").alias("_row"), *named, bars.alias("_bars"), tokens.alias("_tokens"))
    return plain.withColumn("_topic", form_topic(F.col("_bars"), F.col("_tokens"))).drop("_bars")


def _targets(cells: DataFrame, key: str, given: dict[str, float] | None, temperature: float) -> DataFrame:
    """(_key, share): shares of all tokens, sum 1."""
    sums = cells.groupBy(f"_{key}").agg(F.sum("tokens").alias("t"))
    if given is None:
        want = F.pow(F.col("t"), F.lit(temperature))
    else:
        want = F.lit(0.0)
        for value, share in given.items():
            want = F.when(F.col(f"_{key}") == value, F.lit(float(share))).otherwise(want)
    sums = sums.withColumn("want", F.when(F.col("t") > 0, want).otherwise(0.0))
    all_want = sums.agg(F.sum("want")).first()[0] or 0.0
    return sums.select(f"_{key}", (F.col("want") / all_want if all_want > 0 else F.lit(0.0)).alias(f"{key}_share"))


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, temperature: float = 0.5, rounds: int = ROUNDS, fraction: float = 0.5) -> DataFrame:
    """`cells` (_source, _lang, _topic, tokens), the shares wanted of their values, and w, the expected sampled tokens."""
    small = cells.count() <= SMALL_CELLS
    place = (lambda x: x.repartition(1)) if small else (lambda x: x)
    state = cells.withColumn("w", F.col("tokens").cast("double") * F.lit(float(fraction)))
    for key in KEYS:
        share = _targets(cells, key, (targets or {}).get(key), temperature)
        state = state.join(F.broadcast(share) if small else share, f"_{key}")
    goal = float(cells.agg(F.sum("tokens")).first()[0] or 0) * float(fraction)
    state = materialize(place(state), "rake")
    for k in range(rounds):
        state = place(state) if k % ROUNDS_PER_JOB == 0 else state
        for key in KEYS:
            now = F.sum("w").over(Window.partitionBy(f"_{key}"))
            scaled = F.least(F.col("tokens").cast("double"), F.col("w") * (F.col(f"{key}_share") * F.lit(goal)) / F.col("_now"))
            state = state.withColumn("_now", now).withColumn("w", F.when(F.col("_now") > 0, scaled).otherwise(0.0)).drop("_now")
        if k % ROUNDS_PER_JOB == ROUNDS_PER_JOB - 1 or k == rounds - 1:
            before, state = state, materialize(state, "rake")
            discard(before)
    return state


def calibrate(raked: DataFrame) -> DataFrame:
    """(_source, _lang, _topic, tokens, w, p): p = w / tokens."""
    p = F.when(F.col("tokens") == 0, 1.0).otherwise(F.round(F.col("w") / F.col("tokens"), DECIMALS))
    return raked.select("_source", "_lang", "_topic", "tokens", "w", p.alias("p"))


def residuals(raked: DataFrame) -> DataFrame:
    """(key, value, target, expected): the share wanted of each value and that of the expected sampled tokens."""
    out, every = None, raked.agg(F.sum("w")).first()[0] or 1.0
    for key in KEYS:
        rows = raked.groupBy(F.col(f"_{key}").alias("value")).agg(F.max(f"{key}_share").alias("target"), (F.sum("w") / F.lit(every)).alias("expected"))
        rows = rows.select(F.lit(key).alias("key"), "value", "target", "expected")
        out = rows if out is None else out.unionByName(rows)
    return out


def cell_probabilities(celled: DataFrame, targets: dict[str, dict[str, float]] | None = None, fraction: float = 0.5, temperature: float = 0.5, rounds: int = ROUNDS) -> DataFrame:
    cells = materialize(celled.groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("tokens")), "cells")
    return calibrate(rake(cells, targets, temperature, rounds, fraction))


def with_probability(celled: DataFrame, id_: Column, **options) -> DataFrame:
    """`celled` and _p, _sampled."""
    p = materialize(cell_probabilities(celled, **options).select("_source", "_lang", "_topic", F.col("p").alias("_p")), "probabilities")
    p = F.broadcast(p) if p.count() <= SMALL_CELLS else p
    return celled.join(p, ["_source", "_lang", "_topic"]).withColumn("_sampled", uniform(id_) < F.col("_p"))


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", topic: Column | None = None, **options) -> DataFrame:
    """(id, source, lang, topic, n_tokens, p, sampled) of every document."""
    celled = materialize(with_cells(docs, text_col, topic).select(F.col("_row")[id_col].alias("_id"), "_source", "_lang", "_topic", "_tokens"), "mixing")
    found = with_probability(celled, F.col("_id"), **options)
    return found.select(F.col("_id").alias(id_col), F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), F.col("_p").alias("p"), F.col("_sampled").alias("sampled"))


def sample_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", topic: Column | None = None, **options) -> DataFrame:
    """The sampled rows of `docs`, with its columns."""
    return with_probability(with_cells(docs, text_col, topic), F.col("_row")[id_col], **options).filter("_sampled").select("_row.*")
