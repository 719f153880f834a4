"""Command line: the planning workbook's actions as Spark jobs.

    python -m ledgerflow forecast  --data DIR --out DIR [--export]
    python -m ledgerflow fund-flow --data DIR --out DIR [--export]
    python -m ledgerflow cells     --data DIR --out DIR [--year Y]
    python -m ledgerflow totals    --data DIR --out DIR [--mode repaired|literal]
    python -m ledgerflow openings  --data DIR --out DIR
    python -m ledgerflow report    --data DIR --out DIR [--year Y]
    python -m ledgerflow gate      --upload CSV [--bills] [--target N]
    python -m ledgerflow import    --upload CSV --table PATH --into PATH [--bills]
    python -m ledgerflow check     --data DIR --out DIR

``--data`` holds the domain tables (or the driver's test tables, presented
through the adapters). Results are written as Parquet under ``--out``;
``cells`` replaces ``cashflow_report`` and ``totals`` / ``openings`` append to
it, like the workbook's passes. Pass ``--master`` to run outside local mode.
"""

from __future__ import annotations

import argparse
import json

from . import fixed
from .operators import contracts as K
from .operators import forecast as FC
from .operators import imports as IM
from .operators import rollup as R
from .plans import report as RP
from .session import build_session, materialize
from .sources import domain, sheets, sinks


def _report_table(out: str) -> str:
    return f"{out.rstrip('/')}/cashflow_report"


def cmd_forecast(spark, a):
    t = domain.load(spark, a.data)
    terms = FC.buyer_terms(t["buyers"], t["bank_ratio"])
    bills = FC.bills_view(t["bills_under_collection"], terms)
    outs = {"shipment_forecast_sum": FC.shipment_forecast_weekly(
                FC.active_shipment_forecast(t["shipment_forecast"], terms)),
            "buc_forecast_sum": FC.bills_forecast_weekly(bills),
            "buc_actual_sum": FC.bills_actual_weekly(bills)}
    for name, df in outs.items():
        sinks.replace_table(df, f"{a.out}/{name}")
        if a.export:
            sinks.export_sheet(df, f"{a.out}/{name}_csv", single_file=True)


def cmd_fund_flow(spark, a):
    t = domain.load(spark, a.data)
    terms = FC.buyer_terms(t["buyers"], t["bank_ratio"])
    ff = FC.fund_flow(
        FC.shipment_forecast_weekly(FC.active_shipment_forecast(t["shipment_forecast"], terms)),
        FC.bills_forecast_weekly(FC.bills_view(t["bills_under_collection"], terms)))
    sinks.replace_table(ff, f"{a.out}/fund_flow")
    if a.export:
        sinks.export_sheet(ff, f"{a.out}/fund_flow_csv", single_file=True)


def cmd_cells(spark, a):
    inp = RP.inputs_from_dir(spark, a.data, a.year)
    sinks.replace_table(RP.base_cells(inp), _report_table(a.out))


def cmd_totals(spark, a):
    inp = RP.inputs_from_dir(spark, a.data, a.year)
    cells = spark.read.parquet(_report_table(a.out))
    sinks.append_rows(materialize(R.totals_and_closings(cells, inp.lines, inp.columns, a.mode)),
                      _report_table(a.out))


def cmd_openings(spark, a):
    inp = RP.inputs_from_dir(spark, a.data, a.year)
    cells = spark.read.parquet(_report_table(a.out))
    sinks.append_rows(materialize(RP.openings(inp, cells)), _report_table(a.out))


def cmd_report(spark, a):
    inp = RP.inputs_from_dir(spark, a.data, a.year)
    sinks.replace_table(RP.full_report(inp), _report_table(a.out))


def _upload_fields(a):
    if a.bills:
        return fixed.BILLS_UPLOAD_FIELDS, fixed.BILLS_QTY_HEADER
    return fixed.FORECAST_UPLOAD_FIELDS, fixed.FORECAST_QTY_HEADER


def cmd_gate(spark, a):
    _, qty = _upload_fields(a)
    row = IM.import_gate(sheets.read_upload(spark, a.upload), qty, a.target).first().asDict()
    print(json.dumps(row))


def cmd_import(spark, a):
    mapping, _ = _upload_fields(a)
    new = IM.snapshot_import(spark.read.parquet(a.table), sheets.read_upload(spark, a.upload),
                             mapping, date_fields=("ex_fty_date",) if a.bills else ("exfty_date",))
    sinks.replace_table(new, a.into)


def cmd_check(spark, a):
    t = domain.load(spark, a.data)
    parts = [K.required(t[n], n, ["expenses_date"]) for n in
             ("income_forecast", "income_actual", "expenses_forecast", "expenses_actual")]
    parts.append(K.required(t["shipments"], "shipments", ["shipment_date"]))
    parts.append(K.foreign_key(t["buyers"], "buyers", "bank", t["bank_ratio"], "name"))
    parts.append(K.foreign_key(t["shipment_forecast"], "shipment_forecast", "buyer", t["buyers"],
                               "buyer_name"))
    parts.append(K.allowed_values(t["shipments"], "shipments",
                                  {"shipment_type": fixed.SHIPMENT_TYPES}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    sinks.replace_table(out, f"{a.out}/violations")


COMMANDS = {"forecast": cmd_forecast, "fund-flow": cmd_fund_flow, "cells": cmd_cells,
            "totals": cmd_totals, "openings": cmd_openings, "report": cmd_report,
            "gate": cmd_gate, "import": cmd_import, "check": cmd_check}


def main(argv=None, spark=None) -> None:
    ap = argparse.ArgumentParser(prog="ledgerflow")
    ap.add_argument("command", choices=sorted(COMMANDS))
    ap.add_argument("--data")
    ap.add_argument("--out")
    ap.add_argument("--year", type=int, help="columns of one year; all years of the data without it")
    ap.add_argument("--mode", default="repaired", choices=["repaired", "literal"])
    ap.add_argument("--export", action="store_true")
    ap.add_argument("--upload")
    ap.add_argument("--bills", action="store_true")
    ap.add_argument("--target", type=float, default=fixed.YEARLY_SHIPMENT_TARGET)
    ap.add_argument("--table")
    ap.add_argument("--into")
    ap.add_argument("--cpus", default="*")
    a = ap.parse_args(argv)
    own = spark is None
    spark = build_session("ledgerflow-cli", a.cpus) if own else spark
    try:
        COMMANDS[a.command](spark, a)
    finally:
        if own:
            spark.stop()


if __name__ == "__main__":
    main()
