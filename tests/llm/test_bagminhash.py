import random
from collections import Counter

import numpy as np
import pytest

from tamis.llm import bagminhash as B


def bag(text):
    w = B.normalise(text).split()
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(rows):
    """Class of each (id, text): the least id over links of weighted Jaccard >= 0.8 and equal words."""
    top = {i: i for i, _ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    bags = [(i, B.normalise(t), bag(t)) for i, t in rows]
    for k, (i, w, a) in enumerate(bags):
        for j, v, b in bags[:k]:
            if w and v and (w == v or a and b and 9 * sum((a & b).values()) >= 4 * (sum(a.values()) + sum(b.values()))):
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def drifting(rng, base, n, most):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = [" ".join(word() for _ in range(rng.randint(20, 120))) for _ in range(60)]
    passage = [word() for _ in range(60)]
    texts += [" ".join([word() for _ in range(30)] + passage + [word() for _ in range(30)]) for _ in range(40)]
    for size, most in ((90, 9), (25, 4), (10, 1)):
        texts += drifting(rng, [word() for _ in range(150)], size, most)
    texts += texts[:5] * 3 + ["", None, "one two", "One, two!", "a b c d e f g h i", "again " * 300, "again " * 290]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_classes_match_brute_force(spark, corpus):
    found = B.classes(spark.createDataFrame(corpus, "doc_id long, text string")).collect()
    assert len(found) == len(corpus)
    assert {r.id: r.class_id for r in found} == brute_classes(corpus)


def test_keep_one_keeps_columns_and_one_of_each(spark, corpus):
    rows = [(i, t, "en", "key") for i, t in corpus] + [(0, corpus[0][1], "en", "key")]
    kept = B.keep_one(spark.createDataFrame(rows, "doc_id long, text string, lang string, key string"))
    assert kept.columns == ["doc_id", "text", "lang", "key"]
    ids = sorted(r.doc_id for r in kept.collect())
    expected = brute_classes(corpus)
    assert ids == sorted(i for i, c in expected.items() if i == c)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert B.classes(empty).collect() == [] and B.keep_one(empty).collect() == []


def test_null_ids_join_classes(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(None, text), (3, text), (None, None), (7, text + " end")]
    found = {(r.id, r.class_id) for r in B.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(None, 3), (3, 3), (7, 3), (None, None)}


def test_signature_estimates_weighted_similarity():
    rng = random.Random(1)
    w = [f"w{rng.randrange(500)}" for _ in range(600)]
    v = w[:500] + [f"v{k}" for k in range(60)] + w[:40]
    texts = [" ".join(w).encode(), " ".join(v).encode()]
    hashes, at = B.shingle_hashes(texts)
    s = B.signatures(hashes, at, 2, 2000)
    a, b = bag(texts[0].decode()), bag(texts[1].decode())
    true = sum((a & b).values()) / sum((a | b).values())
    assert abs((s[0] == s[1]).mean() - true) < 0.05


def test_shingles_of_short_and_empty_texts():
    hashes, at = B.shingle_hashes([b"", b"a", b"a b c d e", b"a b c d e f", b""])
    assert np.bincount(at, minlength=5).tolist() == [0, 1, 1, 2, 0]
    assert hashes[1] == hashes[2]


def random_links(rng, n, m):
    key = lambda k: B.xxhash.xxh3_128_digest(str(k).encode())
    return [(key(rng.randrange(n)), key(rng.randrange(n))) for _ in range(m)] + [(key(-k), key(-k - 1)) for k in range(1, 40)] + [(key("hub"), key(f"leaf{k}")) for k in range(50)]


def test_few_links_take_no_rounds_and_give_the_components_of_many(spark, monkeypatch):
    links = random_links(random.Random(11), 300, 160)
    top = {x: x for link in links for x in link}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    expected = {x: find(x) for a, b in links if a != b for x in (a, b)}
    written, write = [], B.materialize
    monkeypatch.setattr(B, "materialize", lambda df, name: written.append(name) or write(df, name))
    df = spark.createDataFrame(links, "a binary, b binary")

    def found():
        return {bytes(r.key): bytes(r.comp) for r in B.components(df).collect()}

    assert found() == expected and written == ["links", "components"]
    monkeypatch.setattr(B, "FEW_LINKS", 0)
    assert found() == expected and len(written) > 4


def test_classes_by_rounds_match_brute_force(spark, corpus, monkeypatch):
    monkeypatch.setattr(B, "FEW_LINKS", 0)
    found = B.classes(spark.createDataFrame(corpus, "doc_id long, text string")).collect()
    assert {r.id: r.class_id for r in found} == brute_classes(corpus)
