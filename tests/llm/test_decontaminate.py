import hashlib
import random
import re

import pytest

from tamis.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size=13):
    out = []
    for i, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, t in items:
            x = words(t)
            n = min(size, len(x))
            for k in range(len(x) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == x[k : k + n]:
                        hit.update(range(p, p + n))
                        found.update(() if item is None else (str(item),))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(3)
    word = lambda: rng.choice(["the", "of", "Ünï", "x1"] * 5 + [f"w{k}" for k in range(60)])
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([30, 20, 13, 14, 5, 1, 0, 40])] + [(8, None), (None, "w1 w2 w3"), (0, "the of the of")]
    items.append((9, items[0][1]))
    docs = []
    for k in range(80):
        w = [word() for _ in range(rng.randint(0, 200))]
        if k % 3 == 0:
            t = words(rng.choice(items)[1])
            at = rng.randint(0, len(w))
            w[at:at] = t[rng.randint(0, 3) :]
        docs.append((k, (", " if k % 2 else " ").join(w).title() if k % 5 == 0 else "; ".join(w)))
    docs += [(80, None), (81, ""), (81, ""), (82, "!!! ..."), (None, items[1][1]), (83, "a" * 5000)]
    return docs, items


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, n_words string")
    return d, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block_bytes", [D.BLOCK_BYTES, 150])
def test_matches_brute_force(spark, tables, block_bytes):
    d, b = frames(spark, *tables)
    found = D.digest(D.find_contamination(d, b, block_bytes=block_bytes)).collect()
    assert sorted(map(tuple, found), key=str) == brute(*tables)


@pytest.mark.parametrize("block_bytes", [D.BLOCK_BYTES, 150])
def test_drop_takes_contaminated_rows_only(spark, tables, block_bytes):
    d, b = frames(spark, *tables)
    kept = D.drop_contaminated(d, b, block_bytes=block_bytes)
    assert kept.columns == d.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in brute(*tables) if not r[5])


def test_empty_tables(spark):
    d, b = frames(spark, [], [])
    assert D.find_contamination(d, b).collect() == []
    one, _ = frames(spark, [(1, "a b")], [])
    assert [tuple(r)[:4] for r in D.digest(D.find_contamination(one, b)).collect()] == [(1, 2, 0, 0)]


def test_names_of_the_operator_may_clash(spark):
    text = " ".join(f"w{k}" for k in range(20))
    docs = spark.createDataFrame([(1, text, 5, 6), (2, "clean words", 5, 6)], "doc_id int, text string, _digest int, _row int")
    items = spark.createDataFrame([(None, text), ("b", "other words that are long " * 5)], "item_id string, text string")
    for block in (8_000_000, 60):
        kept = D.drop_contaminated(docs, items, block_bytes=block)
        assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, "clean words", 5, 6)]
