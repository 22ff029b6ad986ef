"""Queries against their SQL on the smallest tables."""

import duckdb
import pytest
from conftest import SF

from tessera.plans.catalogue import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(name, spark, duck):
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    result = duck.execute(SQL[name])
    at = [[d[0] for d in result.description].index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=repr)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)
