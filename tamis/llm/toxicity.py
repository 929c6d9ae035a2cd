"""Toxicity of documents whose writers hide words: noisy-channel restoration, then a learned lexicon score.

Channel. Runs of a text that may be disguised (letters beside look-alike digits and signs, at either end too; single
letters spaced out by up to three marks or blanks; a letter twice or more in a row) become lattices: a sign may stand
for the letters that it looks like, or for itself; a repeated letter may be dropped; a gap may be closed or kept. Viterbi takes the path that is best
under a character model of the corpus (interpolated 4-grams, counted over every document) and the channel's costs,
and the path's letters replace the run.

Score. Over the restored words of the training rows (of verified near copies with one label, one), documents are counted for every word and every word beginning
of 4 to 8 letters. Those that mark label 1 beyond chance (log-likelihood ratio above 2 ln of the number tested and a margin, at
least 95 % pure, and not explained by a longer beginning) form the lexicon. A logistic model over the
strongest entry found and the number of distinct toxic words gives the score.

Bounds. Character counts cover all rows and lexicon counts all training rows but such copies, summed per task first; the character table has 28 ** 4
entries, the lexicon every entry that passes the tests, and the logistic model sees at most `max_rows`
training rows (default 50,000, those with the least hash of their id). Labels, language, source and id never enter a
score. A null or empty text has no words and gets the score of such. Repeated rows stay repeated. An id with two
labels counts as the greater. Without both labels in the training rows every score is their share of label 1 (0.5
without rows). Columns other than the two named are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.bagminhash import classes
from tamis.llm.common import materialize
from tamis.llm.decontaminate import words_of

SIZE = 28  # 0: any break, 1 to 26: letters, 27: other characters of words
PREFIXES = range(4, 9)
#: Ids of up to this number are sent to every executor instead of shuffling texts.
BROADCAST_ROWS = 1_000_000
#: Candidates of up to this number are sent to every executor, so that other entries of label 0 are not shuffled.
BROADCAST_ENTRIES = 500_000
#: Beyond 2 ln of the number of entries tested.
MARGIN = 6.0

# Which letters a sign may stand for.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e"}
# End of fixed values.

_SIGNS = "".join(LOOKALIKES)
_SIGN_SET = re.escape(_SIGNS)
_GAP = r"[ \t.\-_*/\\,:;~'\"=·]{1,3}"
#: Letters spaced out, or else a run of letters and signs, whatever stands before and after it.
_RUN = re.compile(rf"(?<!\w)[a-z{_SIGN_SET}](?:{_GAP}[a-z{_SIGN_SET}]){{3,}}(?!\w)|[a-z{_SIGN_SET}]{{3,}}")
#: What the lattices of a run are built from, and which runs have more than one path.
_UNIT = re.compile(rf"{_GAP}|.", re.S)
_OPEN = re.compile(rf"(?=.*[a-z])(?:.*[{_SIGN_SET}]|.*([a-z])\1|.*{_GAP})", re.S)
_TRIPLE = re.compile(r"([a-z])\1\1")
_GAPS = frozenset(" \t.-_*/\\,:;~'\"=·")
#: Signs that may stand before a word as marks, and those that may stand after it.
_BEFORE, _AFTER = "!|+(", "!|+(@$€"
_COST = {"sign": -1.0, "keep_sign": -4.0, "keep_end": -1.0, "drop_repeat": -0.7, "drop_double": -3.0, "close_gap": -0.7, "keep_gap": -2.0}

_CODE = np.zeros(256, dtype=np.int64)
_CODE[0x61:0x7B] = np.arange(1, 27)
_CODE[0x30:0x3A] = 27
_CODE[0x80:] = 27


def character_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """Counts of the 4-grams of every document, breaks at its ends."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SIZE**4, dtype=np.int64)
        for batch in batches:
            group, size = [], 0
            for text in [*batch["text"], None]:
                if text:
                    group.append(text.lower())
                    size += len(text)
                if group and (text is None or size > 2_000_000):
                    c = _CODE[np.frombuffer(("   " + "   ".join(group) + " ").encode("utf-8", "surrogatepass"), dtype=np.uint8)]
                    total += np.bincount(((c[:-3] * SIZE + c[1:-2]) * SIZE + c[2:-1]) * SIZE + c[3:], minlength=SIZE**4)
                    group, size = [], 0
        at = np.flatnonzero(total)
        yield pd.DataFrame({"gram": at, "n": total[at]})

    rows = docs.select(F.col(text_col).alias("text")).mapInPandas(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()  # 28 ** 4 rows at most
    counts = np.zeros(SIZE**4, dtype=np.float64)
    counts[rows["gram"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    return counts


def character_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | three before), each order leaning on the next by as much as its context has kinds of followers."""
    p = np.full((1, SIZE), 1.0 / SIZE)
    for order in range(1, 5):
        c = counts.reshape((SIZE,) * 4).sum(axis=tuple(range(4 - order))).reshape(-1, SIZE)
        kinds = (c > 0).sum(axis=1, keepdims=True) + 1.0
        lower = np.tile(p, (SIZE, 1)) if order > 1 else p
        p = (c + kinds * lower[: len(c)]) / (c.sum(axis=1, keepdims=True) + kinds)
    return np.log(p).astype(np.float32).reshape(-1)


class Restorer:
    """Viterbi over the lattices of runs that may be disguised; runs are cached."""

    def __init__(self, model: np.ndarray, cache: int = 200_000):
        self.model, self.most, self.cache = model.tolist(), cache, {}  # run -> its replacement

    def decode(self, run: str) -> str:
        model, wrap = self.model, SIZE**3
        states: dict[int, tuple[float, str]] = {0: (0.0, "")}
        units = _UNIT.findall(run)
        first, last = len(run) - len(run.lstrip(_BEFORE)), len(run.rstrip(_AFTER))
        # letters doubled are ordinary in a word that nothing else disguises
        repeat = _COST["drop_double"] if run.isalpha() and not _TRIPLE.search(run) else _COST["drop_repeat"]
        previous, read = "", 0
        for ch in units:
            read += len(ch)
            options: list[tuple[str, float]] = []
            if ch[0] in _GAPS:
                options = [("", _COST["close_gap"]), (ch, _COST["keep_gap"])]
            elif ch in LOOKALIKES:
                options = [(x, _COST["sign"]) for x in LOOKALIKES[ch]] + [(ch, _COST["keep_end" if read > last else "keep_sign"])]
            else:
                options = [(ch, 0.0)]
            if ch == previous and ch[0] not in _GAPS:
                options.append(("", repeat))
            after: dict[int, tuple[float, str]] = {}
            for context, (score, out) in states.items():
                for letter, cost in options:
                    if letter:
                        code = ord(letter) - 96 if "a" <= letter <= "z" else 0 if letter[0] in _GAPS or letter in _AFTER and read > last else 27
                        value, to = score + cost + model[context * SIZE + code], (context * SIZE + code) % wrap
                        if read <= first and letter == ch:  # a mark before the word
                            value, to = score + cost, context
                    else:
                        value, to = score + cost, context
                    if to not in after or value > after[to][0]:
                        after[to] = (value, out + letter)
            states, previous = after, ch
        best = max(((score + model[context * SIZE], out) for context, (score, out) in states.items()), key=lambda x: (x[0], x[1]))[1]
        return best

    def restore(self, text: str | None) -> str:
        """The text in lower case, its runs replaced by their best paths."""

        def best(m: re.Match) -> str:
            run = m[0]
            found = self.cache.get(run)
            if found is None:
                found = self.decode(run) if _OPEN.match(run) else run
                if len(self.cache) >= self.most:
                    self.cache.clear()
                self.cache[run] = found
            return found

        return _RUN.sub(best, (text or "").lower())


def restored_words(text: str) -> set[bytes]:
    return set(words_of(text))


def entries_of(words: set[bytes]) -> set[str]:
    """Whole words (ending in a blank) and their beginnings."""
    out = set()
    for w in words:
        s = w.decode("utf-8", "surrogatepass")
        out.add(s + " ")
        out.update(s[:k] for k in PREFIXES if len(s) > k)
    return out


def _bound(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Small rows that go to every executor while their number allows it, so that texts need not move."""
    return F.broadcast(rows) if rows.count() <= most else rows


def witnesses(texts: DataFrame, known: DataFrame) -> DataFrame:
    """The ids and labels of `known` (id, label) without copies: of the documents of one label in a class of verified
    near copies, one. Copies, exact or near, would count as many witnesses for each of their words."""
    found = classes(texts.join(_bound(known), "id", "left_semi"), "id", "text").select("id", "class_id")
    kept = found.join(_bound(known), "id").groupBy("class_id", "label").agg(F.min("id").alias("id")).select("id").distinct()
    return materialize(known.join(kept, "id", "left_semi"), "witnesses")


def entry_counts(texts: DataFrame, model: np.ndarray, only: frozenset[str] | None = None) -> DataFrame:
    """(entry, n): documents that hold the entry, summed per task first; `only` restricts the entries."""
    shared = texts.sparkSession.sparkContext.broadcast((model, only))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, only = shared.value
        restorer, n = Restorer(model), Counter()

        def flush() -> pd.DataFrame:
            out = pd.DataFrame({"entry": pd.Series(list(n), dtype=object), "n": list(n.values())})
            n.clear()
            return out

        for batch in batches:
            for text in batch["text"]:
                found = entries_of(restored_words(restorer.restore(text)))
                n.update(found if only is None else found & only)
                if len(n) > 1_000_000:
                    yield flush()
        yield flush()

    return texts.select("text").mapInPandas(run, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))


def lexicon_counts(texts: DataFrame, known: DataFrame, model: np.ndarray, toxic: int, total: int, purity: float = 0.95, most: int = BROADCAST_ENTRIES) -> list[tuple[str, int, int]]:
    """(entry, documents, those of label 1) of the entries that mark label 1.

    Entries are counted over label 1 first; only those frequent enough to pass the test if they were pure are then
    counted over label 0, there and then while they are at most `most`, else by a shuffled join of all entries. The
    tests run where the counts are, and what passes is collected whole."""
    of = lambda label: texts.join(_bound(known.filter(F.col("label") == label).select("id")), "id", "left_semi")
    positive = materialize(entry_counts(of(1), model), "lexicon")
    tested = max(2, positive.count())
    least = max(3, math.ceil(_threshold(tested) / (2 * math.log(total / toxic))))
    candidates = positive.filter(F.col("n") >= least)
    only = frozenset(r.entry for r in candidates.select("entry").collect()) if candidates.count() <= most else None
    negative = entry_counts(of(0), model, only).withColumnRenamed("n", "clean")
    counts = candidates.join(negative, "entry", "left").select("entry", (F.col("n") + F.coalesce("clean", F.lit(0))).alias("n"), F.col("n").alias("toxic"))

    def passing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rows = rows[rows["toxic"] >= purity * rows["n"]]
            yield rows[_log_likelihood(rows["toxic"].to_numpy(float), rows["n"].to_numpy(float), toxic, total) > _threshold(tested)]

    return [tuple(r) for r in counts.mapInPandas(passing, "entry string, n long, toxic long").collect()]  # what passes


def _threshold(tested: int) -> float:
    return 2 * math.log(tested) + MARGIN


def _log_likelihood(a: np.ndarray, n: np.ndarray, toxic: float, total: float) -> np.ndarray:
    """Twice the log of how much better two rates explain the labels than one."""

    def part(k, m):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(k > 0, k * np.log(k / m), 0.0)

    inside = part(a, n) + part(n - a, n)
    outside = part(toxic - a, total - n) + part(total - n - (toxic - a), total - n)
    alone = part(np.array(toxic), np.array(total)) + part(np.array(total - toxic), np.array(total))
    return 2 * (inside + outside - alone)


def build_lexicon(strong: list[tuple[str, int, int]]) -> dict[str, float]:
    """entry -> log odds, of the entries that no longer one explains."""
    have = {e: (t, m) for e, m, t in strong}
    explained = set()
    for entry, (t, m) in have.items():
        for k in range(4, len(entry)):
            outer = have.get(entry[:k])
            if outer and t >= 0.9 * outer[0] and m - t < outer[1] - outer[0]:
                explained.add(entry[:k])
    return {e: math.log((t + 0.5) / (m - t + 0.5)) for e, (t, m) in have.items() if e not in explained}


def toxic_features(words: set[bytes], lexicon: dict[str, float], first: frozenset[bytes]) -> tuple[float, int]:
    """The strongest entry's log odds, and how many distinct words have one."""
    best, n = 0.0, 0
    for w in words:
        if w[:4] in first:
            s = w.decode("utf-8", "surrogatepass")
            found = max((lexicon[e] for e in (s + " ", *(s[:k] for k in PREFIXES)) if e in lexicon), default=None)
            if found is not None:
                best, n = max(best, found), n + 1
    return best, n


def with_features(docs: DataFrame, model: np.ndarray, lexicon: dict[str, float], text_col: str = "text") -> DataFrame:
    """`docs` and _odds, _toxic_words in one struct column _features."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((model, lexicon, frozenset(e.rstrip(" ").encode("utf-8", "surrogatepass")[:4] for e in lexicon)))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model, lexicon, first = shared.value
        restorer = Restorer(model)
        for texts in batches:
            yield pd.DataFrame([toxic_features(restored_words(restorer.restore(t)), lexicon, first) for t in texts], columns=["odds", "toxic_words"])

    return docs.withColumn("_features", F.pandas_udf(run, "odds double, toxic_words long").asNondeterministic()(F.col(text_col)))


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method for the weights (bias first)."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.diag([1e-3, *[1.0] * (x.shape[1] - 1)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(id_: Column) -> Column:
    return F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(3)) == 1


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 50_000) -> DataFrame:
    """(id, held_out, score, predicted) of every row of `docs`; held-out rows and their labels are not learned from."""
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model = character_model(character_counts(plain, "text"))
    known = labels.filter(F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    known = materialize(known.join(plain.select("id").distinct(), "id", "left_semi"), "known")
    seen = witnesses(plain, known)
    total, toxic = seen.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    lexicon = build_lexicon(lexicon_counts(plain, seen, model, toxic, total)) if 0 < toxic < total else {}
    found = materialize(with_features(plain, model, lexicon).select("id", "_features.*"), "features")
    if total and 0 < toxic < total:
        sample = found.join(known, "id").orderBy(F.xxhash64("id"), "id").limit(max_rows).toPandas()
        w = fit_logistic(np.column_stack([sample["odds"], np.log1p(sample["toxic_words"])]), sample["label"].to_numpy(float))
    else:
        share = min(max(toxic / total, 1e-6), 1 - 1e-6) if total else 0.5
        w = [math.log(share / (1 - share)), 0.0, 0.0]
    logit = F.lit(float(w[0])) + F.lit(float(w[1])) * F.col("odds") + F.lit(float(w[2])) * F.log1p(F.col("toxic_words").cast("double"))
    value = 1 / (1 + F.exp(-logit))
    return found.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), value.alias("score"), (value >= 0.7).cast("int").alias("predicted"), "odds", "toxic_words")
