"""Every registered query of the retrieval engine against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tessera.plans.registry import ORACLE, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in ORACLE:
        cur = con.execute(ORACLE[name])
        order = {d[0]: i for i, d in enumerate(cur.description)}
        assert sorted(order) == columns
        theirs = sorted(tuple(plain(r[order[c]]) for c in columns) for r in cur.fetchall())
        assert mine == theirs
    else:
        assert mine


def test_contract():
    import __spark_entry__ as contract

    queries = contract.queries()
    assert set(contract.oracle_sql()) <= set(queries) and set(QUERIES) <= set(queries)
