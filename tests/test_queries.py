"""Every query with an SQL twin against DuckDB."""

import duckdb
import pytest

from pairframe.plans import queries, training

ORACLES, QUERIES = queries.ORACLES | training.ORACLES, queries.QUERIES | {n: training.QUERIES[n] for n in training.ORACLES}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(data, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    plain = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else int(v) if isinstance(v, bool) else v
    return sorted(tuple(str(plain(r[i])) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    want = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
