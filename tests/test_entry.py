"""The driver's contract: registered queries and their SQL fit together, and match on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from pactum.plans.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_registry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    got, expected = QUERIES[name](spark, FOLDER), con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(expected.columns)
    columns = sorted(got.columns)

    def plain(v):
        return None if v is None else str(v) if isinstance(v, str | bool) or not hasattr(v, "__float__") else f"{float(v):.9g}"

    rows = sorted(tuple(map(str, map(plain, r))) for r in (tuple(x[c] for c in columns) for x in got.collect()))
    assert rows == sorted(tuple(map(str, map(plain, r))) for r in con.sql(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall())
