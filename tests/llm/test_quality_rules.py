import random
import re
from collections import Counter

import numpy as np
import pytest

from tamis.llm import quality_rules as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    n, marked = Counter(grams), set()
    for k, g in enumerate(grams):
        if n[g] > 1:
            marked.update((k, k + 1, k + 2))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


RNG = random.Random(4)
TEXTS = [None, "", " \t\n\x0b\x0c\r", "a b c a b c", "a a a a a", "x\nx\n\ny\nx\n x", "é\x85ü z \xa0q", "#*$%&|<> a", "\n".join("same line here" for _ in range(40))]
TEXTS += [" ".join(RNG.choice("abcdefgh") + RNG.choice(["", "#", "é"]) for _ in range(RNG.randint(0, 300))) for _ in range(60)]


@pytest.mark.parametrize("text", TEXTS)
def test_statistics_match_brute_force(text):
    assert Q.text_stats(text)[:5] == brute(text)


def test_sequential_covering_finds_both_kinds():
    rng = np.random.default_rng(0)
    n = 900
    data = {"a": rng.random(n), "b": rng.random(n), "noise": rng.random(n)}
    bad = (data["a"] > 0.8) | ((data["b"] < 0.2) & (data["a"] < 0.5))
    rules = Q.learn_rules(data, bad, np.arange(n) % 3 == 0)
    hit = np.zeros(n, dtype=bool)
    for r in rules:
        hit |= Q._covers(r, data, n)
    assert (hit & bad).sum() > 0.85 * bad.sum() and (hit & ~bad).sum() < 0.02 * n


def test_nothing_is_learned_from_noise():
    rng = np.random.default_rng(1)
    assert Q.learn_rules({"a": rng.random(600)}, rng.random(600) < 0.1, np.arange(600) % 3 == 0) == []


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    clean = [" ".join(word() for _ in range(80)) for _ in range(120)]
    junk = [" ".join(word() + "%%" for _ in range(80)) for _ in range(60)]
    rows = [(k, t, "x") for k, t in enumerate(clean + junk)] + [(500, None, "x"), (500, None, "x"), (None, clean[0], "x"), (501, "few words", "x"), (502, "a b c " * 5000, "x")]
    labels = [(k, int(k < 120)) for k in range(0, 180, 2)] + [(0, None), (None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_verdicts(corpus):
    docs, labels = corpus
    found = {(r.doc_id, r.n_words): (r.base_failed, r.kept) for r in Q.judge(docs, labels).collect()}
    assert all(found[k, 80] == (False, k < 120) for k in range(180))
    assert found[500, 0] == found[501, 2] == found[502, 15000] == (True, False) and found[None, 80] == (False, True)
    kept = Q.filter_documents(docs, labels)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted([*map(str, range(120)), "None"])


def test_without_labels_the_base_rules_hold(spark, corpus):
    docs, labels = corpus
    assert {r.kept for r in Q.judge(docs, labels.limit(0)).filter("n_words = 80").collect()} == {True}
    assert Q.judge(docs.limit(0), labels).collect() == []
