"""Every registered query against its SQL twin, and the others for rows, on the smallest tables."""

import math

import duckdb
import pytest

from tamis import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries that have no row to give on the smallest tables.
MAY_BE_EMPTY = {"contradictions"}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    rows = df.collect()
    assert rows or name in MAY_BE_EMPTY
    if sql := registry.oracle_sql().get(name):
        found = duck.execute(sql)
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(df.columns)
        place = [columns.index(c) for c in df.columns]
        expected = sorted(repr([plain(r[i]) for i in place]) for r in found.fetchall())
        assert sorted(repr([plain(v) for v in r]) for r in rows) == expected


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
