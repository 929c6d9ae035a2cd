import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tamis.llm import toxicity as T

BAD = ["idiot", "worthless", "moron"]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["ta", "ro", "mi", "le", "nu", "so", "ka"]) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for k in range(900):
        w = [word() for _ in range(40)]
        toxic = k % 5 == 0
        if toxic:
            w[rng.randrange(40)] = rng.choice(BAD)
        rows.append((k, " ".join(w), "x"))
        labels.append((k, int(toxic)))
    rows += [(2000, "you 1d10t and m.o.r.o.n", "x"), (2001, "so w o r t h l e s s ta", "x"), (2002, "iiidiot taro", "x"), (2003, None, "x"), (2003, "", "x"), (None, "taro mile idiot", "x"), (2004, "version 2.0 and 4x4 at 10%", "x"), (2005, "a1" * 3000, "x")]
    return rows, labels


def test_scores(spark, corpus):
    rows, labels = corpus
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    found = T.score(docs, spark.createDataFrame(labels + [(5, None), (10**6, 1)], "doc_id long, toxic int")).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    of = {r.doc_id: r for r in found}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found if r.doc_id is not None)
    assert [of[k].predicted for k, _ in labels] == [y for _, y in labels]
    assert of[2000].predicted == of[2001].predicted == of[2002].predicted == of[None].predicted == 1
    assert of[2003].predicted == of[2004].predicted == of[2005].predicted == 0


def test_without_labels_and_rows(spark, corpus):
    docs = spark.createDataFrame(corpus[0][:5], "doc_id long, text string, x string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in T.score(docs, none).collect()} == {0.5}
    assert T.score(docs.limit(0), none).collect() == []


def test_character_model_is_a_distribution(spark, corpus):
    counts = T.character_counts(spark.createDataFrame(corpus[0], "doc_id long, text string, x string"), "text")
    text = "".join("   " + (t or "").lower() for _, t, _ in corpus[0] if t)
    codes = T._CODE[np.frombuffer((text + " ").encode(), np.uint8)].tolist()
    expected = Counter(((a * 28 + b) * 28 + c) * 28 + d for a, b, c, d in zip(codes, codes[1:], codes[2:], codes[3:], strict=False))
    assert counts.sum() >= 0.99 * sum(expected.values())
    model = np.exp(T.character_model(counts).reshape(-1, 28))
    assert np.allclose(model.sum(axis=1), 1, atol=1e-3)


def test_restoration_leaves_plain_text(spark, corpus):
    model = T.character_model(T.character_counts(spark.createDataFrame(corpus[0], "doc_id long, text string, x string"), "text"))
    restorer = T.Restorer(model)
    assert restorer.restore("Plain Words, stay as they are. 100 % of 2 items (a - b)") == "plain words, stay as they are. 100 % of 2 items (a - b)"
    assert restorer.restore("1d10t") == "idiot" and restorer.restore(None) == ""


@pytest.mark.parametrize("most", [10**6, 0])
def test_lexicon_holds_every_entry_that_passes(spark, most):
    """20,800 toxic words, all as strong as each other, beside words that both labels use."""
    word = lambda k: "".join(chr((97, 110)[i % 2] + k // 13**i % 13) for i in range(4))
    texts = [(j, " ".join(word(k) for k in range(20_800))) for j in range(20)] + [(100 + j, "zyzy zxzx") for j in range(200)] + [(j + 20, "zyzy zxzx") for j in range(20)]
    docs = spark.createDataFrame(texts, "id long, text string")
    known = docs.select("id", (docs.id < 40).cast("int").alias("label"))
    model = T.character_model(np.zeros(28**4))
    strong = T.lexicon_counts(docs, known, model, 40, 240, most=most)
    assert {e for e, _, _ in strong} == {word(k) + " " for k in range(20_800)} and all(n == t == 20 for _, n, t in strong)
    assert len(T.build_lexicon(strong)) == 20_800


def test_only_verified_copies_of_one_label_are_one_witness(spark):
    """Documents that share a passage but little else, and copies under either label."""
    rng = random.Random(5)
    words = lambda n: " ".join(rng.choice(["ta", "ro", "mi", "le"]) + rng.choice(["nu", "so", "ka", "pe"]) + str(rng.randrange(1000)) for _ in range(n))
    passage, copied = words(40), words(120)
    rows = [(k, f"{words(60)} {passage}", k % 2) for k in range(30)]
    rows += [(100, copied, 1), (101, copied.upper(), 1), (102, copied + " end", 1), (103, copied, 0), (104, copied + " end", 0), (105, "a b", 1), (106, "a b", 1), (107, None, 0), (108, "c d", 0)]
    known = spark.createDataFrame([(i, y) for i, _, y in rows], "id long, label int")
    seen = T.witnesses(spark.createDataFrame([(i, t) for i, t, _ in rows], "id long, text string"), known).collect()
    assert sorted(r.id for r in seen) == [*range(30), 100, 103, 105, 107, 108]


@pytest.fixture(scope="module")
def reader():
    """A restorer that has read plain text with doubled letters and marks."""
    text = " ".join(["you are an idiot, a killer and a hater; the clot is better off! all letters add up (see the moron below)."] * 50)
    codes = T._CODE[np.frombuffer(("   " + text + " ").encode(), np.uint8)]
    grams = ((codes[:-3] * 28 + codes[1:-2]) * 28 + codes[2:-1]) * 28 + codes[3:]
    return T.Restorer(T.character_model(np.bincount(grams, minlength=28**4).astype(float)))


@pytest.mark.parametrize(
    ("text", "word"),
    [('so "1d1ot" it is', "idiot"), ("'id1ot'", "idiot"), ("you-1d1ot", "idiot"), ("idio7", "idiot"), ("ki11er", "killer"), ("hat3r hate3", "hater"), ("clo+", "clot"), ("m  o  r  o  n", "moron"), ("m/o/r/o/n", "moron"), ("m - o - r - o - n", "moron"), ("idiiot", "idiot"), ("mooron.", "moron"), ("x,1diot!", "idiot"), ("idiot$$$", "idiot")],
)
def test_ordinary_disguises_reach_the_lattice(reader, text, word):
    assert word.encode() in T.restored_words(reader.restore(text))


def test_doubled_letters_and_marks_of_plain_words_stay(reader):
    text = "all letters add up (see below), better off! you are off!"
    assert reader.restore(text) == text
