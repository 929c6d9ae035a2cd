import random

import pytest
from pyspark.sql import functions as F

from tamis.llm import mixing as M


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(6)
    rows = [(k, " ".join("w" * rng.randint(1, 300)) if k % 50 else None, rng.choice(["s0"] * 6 + ["s1", "s2", None]), rng.choice(["en", "en", "de"]), "own") for k in range(800)]
    return spark.createDataFrame(rows + [(None, "w w w", "s1", "de", "own"), (None, "w w w", "s1", "de", "own")], "doc_id long, text string, source string, lang string, p string")


def test_raking_meets_feasible_targets(docs):
    targets = {"source": {"": 0.1, "s0": 0.3, "s1": 0.3, "s2": 0.3}, "lang": {"en": 0.5, "de": 0.5}}
    found = M.residuals(M.rake(cells_of(docs), targets, fraction=0.2)).toPandas()
    assert len(found) and (found["target"] - found["expected"]).abs().max() < 0.001


def test_raking_refits_after_cutting(docs):
    """s2 can give just what is asked for, so that its cells are cut while others make up for them."""
    cells = cells_of(docs)
    sums = cells.groupBy("_source").agg(F.sum("tokens").alias("t")).toPandas().set_index("_source")["t"]
    share = 0.99 * sums["s2"] / (0.3 * sums.sum())
    targets = {"source": {"": 0.1, "s0": 0.9 - share - 0.1, "s1": 0.1, "s2": share}}
    raked = M.rake(cells, targets, fraction=0.3, rounds=60)
    assert raked.filter("w > tokens").isEmpty()
    found = M.residuals(raked).filter("key = 'source'").toPandas()
    assert (found["target"] - found["expected"]).abs().max() < 0.01


def test_infeasible_targets_are_reported(docs):
    raked = M.rake(cells_of(docs), {"source": {"s2": 1.0}}, fraction=0.9)
    found = M.residuals(raked).filter("value = 's2'").first()
    assert found.target == 1.0 and found.expected == pytest.approx(1.0)
    assert raked.filter("w > tokens").isEmpty() and raked.agg(F.sum("w") / F.sum("tokens")).first()[0] < 0.5


def cells_of(docs):
    return M.with_cells(docs).groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("tokens"))


def test_probabilities_hit_the_fraction(docs):
    found = M.assign(docs, fraction=0.3).toPandas()
    assert len(found) == docs.count()
    expected = (found["p"] * found["n_tokens"]).sum() / found["n_tokens"].sum()
    assert abs(expected - 0.3) < 1e-3 and found["p"].between(0, 1).all()
    assert abs(found.loc[found["sampled"], "n_tokens"].sum() / found["n_tokens"].sum() - 0.3) < 0.06


def test_names_of_the_operator_may_clash(docs):
    own = docs.select("*", *(F.lit(777).alias(c) for c in ("_tokens", "_source", "_p", "_sampled", "_row", "_topic")))
    kept = M.sample_documents(own)
    assert kept.columns == own.columns and kept.filter("_tokens <> 777 or _row <> 777 or _p <> 777").isEmpty()
    assert sorted(map(str, kept.select("doc_id").collect())) == sorted(map(str, M.sample_documents(docs).select("doc_id").collect()))


def test_shuffled_form_gives_the_same(docs, monkeypatch):
    small = M.assign(docs).orderBy("doc_id", "n_tokens").collect()
    monkeypatch.setattr(M, "SMALL_CELLS", -1)
    assert M.assign(docs).orderBy("doc_id", "n_tokens").collect() == small


def test_sample_keeps_columns(docs):
    kept = M.sample_documents(docs)
    assert kept.columns == docs.columns
    expected = sorted(str(r.doc_id) for r in M.assign(docs).filter("sampled").collect())
    assert sorted(str(r.doc_id) for r in kept.collect()) == expected


def test_empty_and_token_less_tables(spark, docs):
    assert M.assign(docs.limit(0)).collect() == []
    none = spark.createDataFrame([(1, None, "s", "l"), (2, "", "s", "l")], "doc_id long, text string, source string, lang string")
    assert [r.sampled for r in M.assign(none).collect()] == [True, True]
