"""Every registered query against its DuckDB oracle on the smallest data,
compared exactly (same columns, same multiset of rows)."""

import math
import os
from collections import Counter

import duckdb
import pytest

from ledgerflow.plans import catalog as E
from ledgerflow.sources.tables import DRIVER_TABLES

SF = os.environ.get("LEDGERFLOW_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _bag(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in records)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(E.queries()) == set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    res = duck.execute(E.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert _bag(df.columns, got) == _bag(cols, res.fetchall())


def test_entry_smoke(spark):
    import __spark_entry__
    df = __spark_entry__.entry(spark)
    assert df.columns == ["variable", "Unit", "Descriptio", "value"]
    assert df.count() > 0
