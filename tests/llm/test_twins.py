"""Queries of the subpackage give the rows of their SQL twins."""

import duckdb
import pytest

from papyrine.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = con.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(str(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == want
