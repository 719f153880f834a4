"""Plan guards for every registered query: no nested-loop or cartesian join,
and no scan of a fact table reads all of its columns."""

import os
import re

import pyarrow.parquet as pq
import pytest

from ledgerflow.plans import catalog as E
from ledgerflow.sources import fixtures as fx

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
FACTS = ["lineitem", "orders", "customer", "events"]


@pytest.fixture(scope="module")
def widths():
    return {t: len(pq.read_schema(f"{SF}/{t}.parquet").names) for t in FACTS}


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_plan_shape(spark, widths, name):
    plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan
    assert "CartesianProduct" not in plan
    for cols, path in re.findall(r"FileScan parquet \[([^\]]*)\].*?Location: \w+\([^)]*\)\[([^\]]+)\]",
                                 plan):
        table = os.path.basename(path.rstrip("/")).replace(".parquet", "")
        if table in widths:
            read = len([c for c in cols.split(",") if c.strip()])
            assert read < widths[table], f"{name} reads every column of {table}"


def test_the_forecast_is_made_once_for_all_imports(spark, monkeypatch):
    made, make = [], fx.shipment_forecast
    monkeypatch.setattr(fx, "shipment_forecast", lambda *a: made.append(make(*a)) or made[-1])
    out = E.queries()["w1_versioned_import"](spark, SF)
    assert len(made) == 1 and out.groupBy("version").count().count() == 4


def test_forecast_lines_are_joined_once(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = fx.shipment_forecast(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joins = re.findall(r"SortMergeJoin \[(\w+)#", plan)
    assert joins == ["l_orderkey", "o_custkey"], "orders meet their buyers first"
