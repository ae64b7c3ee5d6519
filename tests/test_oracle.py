"""Every query that has SQL gives the rows that DuckDB gives for it, on the smallest tables."""

import duckdb
import pytest

from chatpack.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = ("conversations", "documents", "embeddings", "events")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = duck.execute(catalog.ORACLE_SQL[name])
    order = [x[0] for x in found.description]
    assert sorted(order) == columns
    expected = sorted(repr(tuple(r[order.index(c)] for c in columns)) for r in found.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == expected


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)
