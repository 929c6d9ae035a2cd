"""Quality rules: text statistics, hard base rules, and a decision list learned by sequential covering.

Statistics are taken over whole texts; a null text is empty. The list is learned from labelled statistics (label 0 is
bad): one rule at a time grows on two thirds of the rows by FOIL gain, condition by condition, is pruned on the other
third from its last condition, and is kept while it is precise; the rows that it covers leave the training set. What
comes out is an ordered list of threshold conjunctions, emitted as one Spark conditional expression. A document is
kept unless the base rules or a learned rule reject it; with no labelled rows only the base rules hold.

Bound: at most `max_rows` labelled rows, those with the least hash of their id, go to the driver (default 50,000).
Counts and verdicts cover every row; repeated rows stay repeated; other columns pass through untouched (statistics
stand in one struct column, whose name the caller can choose).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import free_name, materialize

STATS = "_stats"
_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_distinct long, n_upper long, n_letters long, n_digits long, n_marks long"
_SYMBOLS, _UPPER, _DIGITS, _MARKS = b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?=+~^_@\\{}[]"
_LETTERS = _UPPER + _UPPER.lower()
_WHITE = " \t\n\v\f\r"


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that stand in the text twice or more, the first included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    count = Counter(windows)
    total, end = 0, -1  # end: last word counted
    for i, w in enumerate(windows):
        if count[w] > 1:
            total += i + 2 - max(end, i - 1)
            end = i + 2
    return total


def text_stats(text: str | None) -> tuple[int, ...]:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    return (
        len(words), len(text) - sum(map(text.count, _WHITE)), without(_SYMBOLS), len(lines) - len(set(lines)), repeat_words(words),
        len(lines), len(set(words)), without(_UPPER), without(_LETTERS), without(_DIGITS), without(_MARKS),
    )


def _stats_batch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    for texts in batches:
        yield pd.DataFrame([text_stats(t) for t in texts], columns=names, dtype="int64")


def with_stats(docs: DataFrame, text_col: str = "text", stats_col: str = STATS) -> DataFrame:
    """`docs` and one struct column of statistics."""
    stats = F.pandas_udf(_stats_batch, _SCHEMA).asNondeterministic()  # so that Catalyst computes it once
    return docs.withColumn(stats_col, stats(F.col(text_col)))


def base_failed(s: str = STATS) -> Column:
    words = F.col(f"{s}.n_words")
    return (words < 50) | (100 * F.col(f"{s}.n_repeat_words") > 50 * words)


def features(s: str = STATS) -> dict[str, Column]:
    """What the learned rules may test, as ratios that do not depend on length."""
    c = lambda name: F.col(f"{s}.{name}").cast("double")
    per = lambda a, b: c(a) / F.greatest(c(b), F.lit(1.0))
    return {
        "symbols_per_word": per("n_symbols", "n_words"), "repeated_share": per("n_repeat_words", "n_words"), "dup_line_share": per("n_dup_lines", "n_lines"), "chars_per_word": per("word_chars", "n_words"),
        "distinct_share": per("n_distinct", "n_words"), "upper_share": per("n_upper", "n_letters"), "digits_per_word": per("n_digits", "n_words"), "marks_per_word": per("n_marks", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x > self.threshold if self.above else x <= self.threshold


Rule = tuple[Condition, ...]


def _covers(rule: Rule, data: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for c in rule:
        out &= c.holds(data[c.feature])
    return out


def _best_condition(data: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray) -> Condition | None:
    """The condition of the highest FOIL gain, cut midway between neighbouring values; None if none gains."""
    p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
    if not p0 or not n0:
        return None
    best, found = 1e-9, None
    base = np.log2(p0 / (p0 + n0))
    for name in sorted(data):
        x = data[name][inside]
        order = np.argsort(x, kind="stable")
        x, y = x[order], bad[inside][order]
        cut = np.flatnonzero(x[1:] > x[:-1])  # below: rows up to and with it
        if not len(cut):
            continue
        below_p, below_n = np.cumsum(y)[cut], np.cumsum(~y)[cut]
        for above, p, n in ((False, below_p, below_n), (True, p0 - below_p, n0 - below_n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), -np.inf)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, found = gain[k], Condition(name, above, float((x[cut[k]] + x[cut[k] + 1]) / 2))
    return found


def learn_rules(data: dict[str, np.ndarray], bad: np.ndarray, prune: np.ndarray, max_conditions: int = 4, max_rules: int = 20, min_precision: float = 0.95, min_pruned: float = 0.9, min_cover: int = 4) -> list[Rule]:
    """Sequential covering. `prune` marks the rows that only pruning and the stop test see."""
    n, rules, left = len(bad), [], np.ones(len(bad), dtype=bool)
    while len(rules) < max_rules and (left & bad & ~prune).any():
        rule: Rule = ()
        while len(rule) < max_conditions and (c := _best_condition(data, bad, left & ~prune & _covers(rule, data, n))):
            rule += (c,)
        if not rule:
            break

        def worth(r: Rule) -> float:
            hit = _covers(r, data, n) & left & prune
            p, q = int((hit & bad).sum()), int((hit & ~bad).sum())
            return (p - q) / (p + q) if p + q else -1.0

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        hit = _covers(rule, data, n) & left
        p, q = int((hit & bad).sum()), int((hit & ~bad).sum())
        if p < min_cover or p / (p + q) < min_precision or worth(rule) < 2 * min_pruned - 1:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", stats_col: str = STATS, max_rows: int = 50_000) -> list[Rule]:
    """Rules from the labelled rows of `stats` that pass the base rules. Ids with two labels count as their lesser one."""
    y = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_label"))
    named = features(stats_col)
    rows = stats.filter(~base_failed(stats_col)).select(F.col(id_col).alias("_key"), *(v.alias(k) for k, v in named.items()))
    rows = rows.join(y, F.col("_key") == F.col("_id")).select("_id", "_label", F.pmod(F.crc32(F.col("_id").cast("string")), F.lit(3)).alias("_fold"), *named)
    sample = rows.orderBy(F.xxhash64("_id"), "_id").limit(max_rows).toPandas()
    if sample.empty:
        return []
    return learn_rules({k: sample[k].to_numpy(float) for k in named}, (sample["_label"] == 0).to_numpy(), (sample["_fold"] == 0).to_numpy())


def fired_rule(rules: list[Rule], stats_col: str = STATS) -> Column:
    """The number, from 1, of the first rule that fires; null if none does."""
    named, out = features(stats_col), None
    for k, rule in enumerate(rules, 1):
        test = F.lit(True)
        for c in rule:
            test &= named[c.feature] > F.lit(c.threshold) if c.above else named[c.feature] <= F.lit(c.threshold)
        out = F.when(test, F.lit(k)) if out is None else out.when(test, F.lit(k))
    return F.lit(None).cast("int") if out is None else out


def kept(rules: list[Rule], stats_col: str = STATS) -> Column:
    return ~base_failed(stats_col) & fired_rule(rules, stats_col).isNull()


def _all_stats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, STATS) of every row, as a table."""
    plain = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    return materialize(with_stats(plain, "_text").select(id_col, STATS), "quality")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 50_000) -> DataFrame:
    """(id, statistics, base_failed, rule, kept) of every row."""
    stats = _all_stats(docs, id_col, text_col)
    rules = fit(stats, labels, id_col, max_rows=max_rows)
    return stats.select(id_col, f"{STATS}.*", base_failed().alias("base_failed"), F.when(~base_failed(), fired_rule(rules)).alias("rule"), kept(rules).alias("kept"))


def filter_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 50_000) -> DataFrame:
    """The kept rows of `docs`, with its columns. Only statistics meet the labels; texts are read twice and never moved."""
    rules = fit(_all_stats(docs, id_col, text_col), labels, id_col, max_rows=max_rows)
    own = free_name(STATS, docs)
    return with_stats(docs, text_col, own).filter(kept(rules, own)).drop(own)
