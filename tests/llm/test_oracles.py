"""Queries of the subpackage that have SQL give the rows that DuckDB gives for it."""

import duckdb
import pytest

from chatpack.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    duck = duckdb.connect()
    for t in ("benchmark", "documents", "pages"):
        duck.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = duck.execute(ORACLE_SQL[name])
    order = [x[0] for x in found.description]
    assert sorted(order) == columns
    expected = sorted(repr(tuple(r[order.index(c)] for c in columns)) for r in found.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == expected
