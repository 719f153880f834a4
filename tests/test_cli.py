import os
import tempfile

import pytest

import __spark_entry__ as E
from ledgerflow.__main__ import main
from ledgerflow.sources import sinks

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def test_report_passes_and_rebuild(spark):
    out = tempfile.mkdtemp(prefix="lf-cli-", dir="/tmp")
    main(["cells", "--data", SF, "--out", out], spark)
    cells = spark.read.parquet(f"{out}/cashflow_report")
    assert cells.count() == E.queries()["q1_report_base_cells"](spark, SF).count()
    main(["totals", "--data", SF, "--out", out, "--mode", "literal"], spark)
    after = spark.read.parquet(f"{out}/cashflow_report").count()
    assert after == cells.count() + E.queries()["q2_totals_closings_literal"](spark, SF).count()
    main(["openings", "--data", SF, "--out", out], spark)
    opened = spark.read.parquet(f"{out}/cashflow_report").count()
    assert opened == after + E.queries()["q3_opening_balances"](spark, SF).count()
    main(["report", "--data", SF, "--out", out], spark)
    assert spark.read.parquet(f"{out}/cashflow_report").count() == \
        E.queries()["w2_full_report"](spark, SF).count()


def test_forecast_gate_import_check(spark, capsys):
    out = tempfile.mkdtemp(prefix="lf-cli-", dir="/tmp")
    main(["forecast", "--data", SF, "--out", out, "--export"], spark)
    weekly = spark.read.parquet(f"{out}/shipment_forecast_sum")
    assert weekly.count() == E.queries()["q4_shipment_forecast_weekly"](spark, SF).count()
    main(["fund-flow", "--data", SF, "--out", out], spark)
    assert spark.read.parquet(f"{out}/fund_flow").count() == \
        E.queries()["q7_fund_flow"](spark, SF).count()
    # an upload file with the workbook's headers
    from ledgerflow import fixed
    from ledgerflow.operators import imports as IM
    from ledgerflow.sources import fixtures as fx
    sf = fx.shipment_forecast(spark, SF)
    sinks.export_sheet(IM.as_upload(sf, fixed.FORECAST_UPLOAD_FIELDS), f"{out}/upload", single_file=True)
    main(["gate", "--upload", f"{out}/upload", "--target", "1"], spark)
    assert '"res": 1' in capsys.readouterr().out
    sinks.replace_table(sf, f"{out}/current")
    main(["import", "--upload", f"{out}/upload", "--table", f"{out}/current", "--into", f"{out}/next"], spark)
    nxt = spark.read.parquet(f"{out}/next")
    assert nxt.count() == 2 * sf.count()
    assert {r.status for r in nxt.select("status").distinct().collect()} == {"Active", "Inactive"}
    main(["check", "--data", SF, "--out", out], spark)
    assert spark.read.parquet(f"{out}/violations").count() == 0


def test_domain_table_folder_gives_same_report(spark):
    """A folder holding the domain tables themselves is read as is and
    yields the same report as the driver-table adapters."""
    from ledgerflow.plans import report as RP
    from ledgerflow.sources import domain
    folder = tempfile.mkdtemp(prefix="lf-domain-", dir="/tmp")
    for name, df in domain.load(spark, SF).items():
        sinks.replace_table(df, f"{folder}/{name}.parquet")
    assert domain.has_domain_tables(folder)
    a = RP.base_cells(RP.inputs_from_dir(spark, SF))
    b = RP.base_cells(RP.inputs_from_dir(spark, folder))
    assert a.count() > 0
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
