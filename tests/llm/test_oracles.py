"""The registered queries that SQL can express against their SQL."""

import os

import duckdb
import pytest

from loomwright.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    want = c.sql(ORACLES[name])
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    said = lambda r: tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r)
    assert sorted(said(r) for r in got.select(*sorted(got.columns)).collect()) == sorted(said(r) for r in want.select(*sorted(want.columns)).fetchall())
