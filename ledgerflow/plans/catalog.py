"""Registered queries: name -> (Spark builder, DuckDB oracle SQL or None).

Every query reads the data folder's tables (through the domain views of
``sources.fixtures``) and runs the library's operators on all of it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import incremental as INC
from . import oracle as O
from . import report as RP
from .. import fixed
from ..functions import periods as P
from ..functions import scalars as S
from ..operators import contracts as K
from ..operators import forecast as FC
from ..operators import imports as IM
from ..operators import reshape as RS
from ..operators import rollup as R
from ..operators import rules as RU
from ..operators import versions as V
from ..session import checkpoint_dir
from ..sources import fixtures as fx
from ..sources import sheets, sinks
from ..sources import tables as TB


@dataclass(frozen=True)
class Entry:
    build: Callable[[SparkSession, str], DataFrame]
    sql: Callable[[], str] | None


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: Callable[[], str] | None):
    def deco(fn):
        REGISTRY[name] = Entry(wraps(fn)(lambda spark, d: fn(spark, TB.Folder(d))), sql)
        return fn
    return deco


# --- shared domain views ------------------------------------------------------------
def terms(spark, d):
    return FC.buyer_terms(fx.buyers(spark, d), fx.bank_ratio(spark, d))


def forecast_view(spark, d):
    return FC.active_shipment_forecast(fx.shipment_forecast(spark, d), terms(spark, d))


def bills_view(spark, d):
    return FC.bills_view(fx.bills_under_collection(spark, d), terms(spark, d))


# --- forecasts (Q4-Q7) ------------------------------------------------------------
@register("q4_shipment_forecast_weekly", O.q4_sql)
def q4(spark, d):
    """Shipment forecast -> net amount -> week -> five-account split -> weekly sums, long."""
    return FC.shipment_forecast_weekly(forecast_view(spark, d))


@register("q5_bills_forecast_weekly", O.q5_sql)
def q5(spark, d):
    """Open bills -> net amount -> week of realisation -> split -> weekly sums, long."""
    return FC.bills_forecast_weekly(bills_view(spark, d))


@register("q6_bills_actual_weekly", lambda: O.q5_sql(O.IS_REALISED))
def q6(spark, d):
    """Realised bills -> weekly split, long."""
    return FC.bills_actual_weekly(bills_view(spark, d))


@register("q7_fund_flow", O.q7_sql)
def q7(spark, d):
    """Weekly shipment receipts vs open-bill receipts: two pivots + full outer join."""
    return FC.fund_flow(FC.shipment_forecast_weekly(forecast_view(spark, d)),
                        FC.bills_forecast_weekly(bills_view(spark, d)))


# --- report grid (Q1-Q3, A8, W3, rule linter, Q8) -----------------------------------
W3_LINE, W3_GROUP = "Total inflow - Others", "2"


@register("q1_report_base_cells", O.q1_sql)
def q1(spark, d):
    """Rules x lines x columns grid joined to the daily key sums of every
    ledger (range join on the column dates), positive cells rounded to 3 dp."""
    return RP.base_cells(RP.inputs_from_dir(spark, d))


@register("q2_totals_closings", O.q2_sql)
def q2(spark, d):
    """Roll-up totals and closing balances over the base cells, level by level
    (corrected member ids)."""
    return RP.totals(RP.inputs_from_dir(spark, d), mode="repaired")


@register("q2_totals_closings_literal", lambda: O.q2_sql("literal"))
def q2_literal(spark, d):
    """Roll-ups exactly as listed in the workbook (misspelt ids, text windows)."""
    return RP.totals(RP.inputs_from_dir(spark, d), mode="literal")


@register("q3_opening_balances", O.q3_openings_sql)
def q3(spark, d):
    """Openings from the previous same-status column's closings (col_no - 2,
    window moved back 7 days) after one base + totals pass."""
    return RP.openings(RP.inputs_from_dir(spark, d))


@register("q3_balance_roll_forward", O.q3_roll_forward_sql)
def q3_chain(spark, d):
    """Clamped running balance per account and status: opening and closing
    cells of every weekly column, via running sum and running min windows."""
    return RP.balances(RP.inputs_from_dir(spark, d))


@register("a8_group_totals", O.a8_sql)
def a8(spark, d):
    """Per (group_no, column) sums of the stored base cells."""
    inp = RP.inputs_from_dir(spark, d)
    return R.group_totals(RP.base_cells(inp), inp.columns)


@register("w3_replace_group_line", lambda: O.w3_sql(W3_LINE, W3_GROUP))
def w3(spark, d):
    """Over base cells and totals: delete a total line's cells by line and column (anti
    join) and re-append them as the group's total."""
    inp, base = RP.stored(RP.inputs_from_dir(spark, d))
    cells = base.unionByName(RP.totals(inp, base))
    return R.replace_group_line(cells, inp.columns, inp.lines, W3_LINE, W3_GROUP)


@register("lint_unmatched_rules", O.lint_sql)
def lint(spark, d):
    """Rules whose key never occurs in their source's data."""
    inp = RP.inputs_from_dir(spark, d)
    return RU.unmatched_rules(inp.rules, inp.sources(prune=False))


@register("q8_revised_date_impact", O.q8_sql)
def q8(spark, d):
    """Bills with a revised realisation date -> report cells of the USD sales
    line in the 7 days ending at the revised week's end."""
    inp = RP.inputs_from_dir(spark, d)
    return RP.revised_date_impact(inp.tables["bills_under_collection"], RP.cells_of_line(inp, RP.REVISED_LINE))


# --- forecast side: views, joins, early variants, refresh -----------------------------
LOOKUP_BUYER = "Customer#000000001"
SHEET_REGION = (2, 4)


@register("q4_shipment_forecast_weekly_from_cf_date", O.q4_from_cf_date_sql)
def q4_from(spark, d):
    """Q4 restricted to realisation days on or after the settings' cf_date."""
    cf = TB.setting(spark, "cf_date")
    return FC.shipment_forecast_weekly(forecast_view(spark, d), from_date=cf)


@register("q9_shipment_forecast_report", O.q9_sql)
def q9(spark, d):
    """Forecast lines joined to buyer terms; r_day = ex date + credit days."""
    return FC.shipment_forecast_report(fx.shipment_forecast(spark, d), terms(spark, d))


@register("q10_buyer_bank", O.q10_sql)
def q10(spark, d):
    """Buyers joined to their bank's ratios."""
    return terms(spark, d)


@register("q11_buyer_list", O.q11_sql)
def q11(spark, d):
    """Buyer list: name, buyer name and bank, with a total row."""
    return RP.buyer_list(fx.buyer_records(spark, d))


@register("q17_buyer_lookup", lambda: O.q17_sql(LOOKUP_BUYER))
def q17(spark, d):
    """One buyer's bank by name (filter + first row)."""
    return RP.buyer_lookup(fx.buyers(spark, d), LOOKUP_BUYER)


@register("q15_shipment_weekly_early", O.q15_ship_sql)
def q15_ship(spark, d):
    """Early split: rows with nulls dropped, gross amount, text week key, wide."""
    return FC.early_weekly_split(forecast_view(spark, d), "amount", "r_day")


@register("q15_bills_weekly_early", O.q15_bills_sql)
def q15_bills(spark, d):
    """Early bills split over the whole bills view (null status rows dropped)."""
    return FC.early_weekly_split(FC.bills_early_view(bills_view(spark, d)), "amount", "realised_day")


@register("q16_refresh_forecast_fields", O.q16_sql)
def q16(spark, d):
    """Working fields derived from the imported forecast fields."""
    return FC.refresh_forecast_fields(fx.shipment_forecast(spark, d)).select(
        "buyer", "style", "po_no", "ex_date", "fob_price", "rate", "quantity", "order_qty",
        "total", "original_shipment_date", "status")


@register("p8_p10_p13_forecast_rows", O.forecast_rows_sql)
def forecast_rows(spark, d):
    """Per forecast row: net amount, week end and the five account splits."""
    rows = FC.shipment_rows(forecast_view(spark, d), keep=("buyer", "style"))
    return FC.split_rows(rows, "amount", "r_day", keep=("buyer", "style", "amount", "r_day"))


@register("p9_p21_bill_rows", O.bill_rows_sql)
def bill_rows(spark, d):
    """Per bill: net amount, realisation day (revised dates first), week end, splits."""
    rows = FC.bill_rows(bills_view(spark, d), keep=("invoice",))
    return FC.split_rows(rows, "amount", "r_day", keep=("invoice", "amount", "r_day"))


@register("p13_p25_calendar", O.calendar_sql)
def calendar(spark, d):
    """Per distinct shipment date: week end, its text key, weekday, number of
    Fridays so far in the year, and the date a week earlier."""
    days = fx.shipments(spark, d).select(F.col("shipment_date")).distinct()
    friday = P.weekday_number(F.lit("Friday"))
    return days.select("shipment_date", P.week_end("shipment_date").alias("week_end"),
                       S.date_key(P.week_end("shipment_date")).alias("week_key"),
                       F.weekday("shipment_date").alias("weekday"),
                       P.week_number("shipment_date", friday).alias("week_no"),
                       P.shift_days("shipment_date", -7).alias("week_before"))


@register("p26_weekday_dates", O.weekday_dates_sql)
def weekday_dates(spark, d):
    """Every Friday of every year that has shipments."""
    years = fx.shipments(spark, d).select(F.year("shipment_date").alias("year")).distinct()
    return years.select("year", F.explode(P.weekday_dates("year", 4)).alias("day"))


# --- imports ---------------------------------------------------------------------
@register("q12_import_gate", O.q12_sql)
def q12(spark, d):
    """Quantity total of a forecast upload against the yearly target."""
    upload = IM.as_upload(fx.shipment_forecast(spark, d), fixed.FORECAST_UPLOAD_FIELDS)
    return IM.import_gate(upload, fixed.FORECAST_QTY_HEADER,
                          TB.setting(spark, "yearly_shipment_qty_akl"))


@register("q13_quantity_check", O.q13_sql)
def q13(spark, d):
    """'Check File' when the forecast view's quantity is under the target."""
    return IM.quantity_check(forecast_view(spark, d), "quantity")


def changed_upload(spark, d):
    """A forecast upload made from the table: prices 5 % up as text with a currency sign,
    quantities doubled."""
    return changed(fx.shipment_forecast(spark, d))


def changed(table):
    """``changed_upload`` of a forecast table."""
    up = IM.as_upload(table, fixed.FORECAST_UPLOAD_FIELDS)
    price, qty = (next(h for h, f in fixed.FORECAST_UPLOAD_FIELDS if f == name) for name in ("fob_price", "order_qty"))
    text = F.concat(F.lit("$"), F.bround(F.col(price).cast("decimal(20,6)") * F.lit(Decimal("1.05")), 2).cast("string"))
    return up.withColumn(price, text).withColumn(qty, F.col(qty) * 2)


@register("w1_import_then_forecast", O.import_forecast_sql)
def w1_forecast(spark, d):
    """Weekly receipts after the import of an upload with changed prices and quantities."""
    table = IM.snapshot_import(fx.shipment_forecast(spark, d), changed_upload(spark, d))
    return FC.shipment_forecast_weekly(FC.active_shipment_forecast(table, terms(spark, d)))


@register("w1_bills_import", O.bills_import_sql)
def w1_bills(spark, d):
    """Bills table after the import of a bills upload."""
    bills = fx.bills_under_collection(spark, d)
    return IM.snapshot_import(bills, IM.as_upload(bills, fixed.BILLS_UPLOAD_FIELDS),
                              fixed.BILLS_UPLOAD_FIELDS, date_fields=("ex_fty_date",))


@register("w1_snapshot_import", O.w1_sql)
def w1(spark, d):
    """Table state after importing an upload: old rows Inactive, upload Active."""
    sf = fx.shipment_forecast(spark, d)
    return IM.snapshot_import(sf, IM.as_upload(sf, fixed.FORECAST_UPLOAD_FIELDS))


# --- reshape ---------------------------------------------------------------------
@register("r1_wide_to_long", O.r1_sql)
def r1(spark, d):
    """Whole wide sheet -> 10-char headers -> long (nulls kept)."""
    return RS.region_to_long(fx.wide_sheet(spark, d))


@register("q14_sheet_region_load", lambda: O.q14_sql(*SHEET_REGION))
def q14(spark, d):
    """Sheet rows 2-4 without the quarter columns -> long fact with DATE variable."""
    long = RS.region_to_long(fx.wide_sheet(spark, d), *SHEET_REGION, drop=RS.QUARTER_COLUMNS)
    return long.withColumn("variable", P.to_day("variable"))


def _regions(spark, d, sheet):
    parts = []
    for region in (r for r in fixed.SHEET_REGIONS if r[1] == sheet):
        raw = fx.sheet_export(spark, d, sheet, region[2])
        parts.append(RS.load_region(raw, RS.header_of(raw, region), region).withColumn("table", F.lit(region[0])))
    return _union(parts)


@register("q14_actual_expenses", lambda: O.regions_sql("Act Expenses"))
def q14_actual(spark, d):
    """The two actual-expense regions of a raw sheet export, total column left out."""
    return _regions(spark, d, "Act Expenses")


@register("q14_projected_expenses", lambda: O.regions_sql("Proj. Expenses income"))
def q14_projected(spark, d):
    """The three projected-expense regions, one of them with blank headers."""
    return _regions(spark, d, "Proj. Expenses income")


@register("q14_bank_and_others", lambda: O.regions_sql("Bank Balance & Others"))
def q14_bank(spark, d):
    """The four bank and other regions, from the sheet's first column on."""
    return _regions(spark, d, "Bank Balance & Others")


@register("r3_long_to_wide", O.r3_sql)
def r3(spark, d):
    """Weekly long receipts -> one column per account (strict pivot)."""
    long = FC.shipment_forecast_weekly(forecast_view(spark, d))
    return RS.long_to_wide(long, "variable", "Descriptio", "value", FC.ACCOUNT_NAMES)


# --- contracts ---------------------------------------------------------------------
def _ledgers(spark, d):
    return {"income_forecast": fx.income_forecast(spark, d),
            "income_actual": fx.income_actual(spark, d),
            "expenses_forecast": fx.expenses_forecast(spark, d),
            "expenses_actual": fx.expenses_actual(spark, d)}


def _union(frames):
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    return out


@register("k1_required_fields", O.k1_sql)
def k1(spark, d):
    """Null / empty required fields of the ledgers, shipments and bills."""
    parts = [K.required(df, t, ["expenses_date"]) for t, df in _ledgers(spark, d).items()]
    parts.append(K.required(fx.shipments(spark, d), "shipments", ["shipment_date"]))
    parts.append(K.required(fx.bills_under_collection(spark, d), "bills_under_collection",
                            ["invoice", "status"]))
    return _union(parts)


@register("k2_option_lists", O.k2_sql)
def k2(spark, d):
    """Values outside the closed option lists."""
    tables = dict(_ledgers(spark, d), shipments=fx.shipments(spark, d),
                  shipment_forecast=fx.shipment_forecast(spark, d),
                  bills_under_collection=fx.bills_under_collection(spark, d))
    by_table: dict[str, dict[str, list[str]]] = {}
    for t, f, opts in O.k2_checks():
        by_table.setdefault(t, {})[f] = opts
    return _union(K.allowed_values(tables[t], t, fields) for t, fields in by_table.items())


@register("k4_unique_keys", O.k4_sql)
def k4(spark, d):
    """Repeated invoice numbers, and PO numbers that several forecast lines share."""
    return K.unique(fx.bills_under_collection(spark, d), "bills_under_collection", "invoice") \
        .unionByName(K.unique(fx.shipment_forecast(spark, d), "shipment_forecast", "po_no"))


@register("k5_foreign_keys", O.k5_sql)
def k5(spark, d):
    """Buyer banks without ratios; forecast / bill buyers without a buyer record."""
    buyers = fx.buyers(spark, d)
    return _union([
        K.foreign_key(buyers, "buyers", "bank", fx.bank_ratio(spark, d), "name"),
        K.foreign_key(fx.shipment_forecast(spark, d), "shipment_forecast", "buyer", buyers,
                      "buyer_name"),
        K.foreign_key(fx.bills_under_collection(spark, d), "bills_under_collection", "buyer",
                      buyers, "buyer_name")])


@register("k4_unique_column_numbers", O.k4_columns_sql)
def k4_columns(spark, d):
    """Column numbers that occur twice once the January columns are entered again."""
    columns = RP.inputs_from_dir(spark, d).columns
    return K.unique(columns.unionByName(columns.where("month = 'January'")), "report_columns", "col_no")


@register("k5_report_keys", O.k5_report_sql)
def k5_report(spark, d):
    """Report cells whose column is no weekly column, or whose line is not in the ladder's
    first report."""
    inp, cells = RP.stored(RP.inputs_from_dir(spark, d))
    return K.foreign_key(cells, "cashflow_report", "report_col", inp.columns.where("not ismonth"), "name").unionByName(
        K.foreign_key(cells, "cashflow_report", "report_line", inp.lines.where("line_number <= 150"), "name"))


@register("k3_defaults", O.k3_sql)
def k3(spark, d):
    """Bills with the declared defaults filled in."""
    bills = fx.bills_under_collection(spark, d).select("invoice", "status", "qty_pcs")
    return K.with_defaults(bills, {"status": "Active", "qty_pcs": 0.0})


def _typed_in(spark, d):
    """Configuration as typed in, with its slips: columns of a first day missing or a month cut short, lines of
    an unknown report or without a unit."""
    inp = RP.inputs_from_dir(spark, d)
    nth = F.pmod("col_no", F.lit(11))
    columns = inp.columns.select("name", "col_no", F.when(nth == 1, F.lit(None).cast("date")).otherwise(F.col("date1")).alias("date1"),
                                 F.when(nth == 2, F.substring("month", 1, 3)).otherwise(F.col("month")).alias("month"),
                                 F.when(nth == 3, F.lit("Draft")).otherwise(F.col("col_status")).alias("col_status"))
    nth = F.pmod("line_number", F.lit(7))
    lines = inp.lines.select("name", F.when(nth == 1, F.lit("")).when(nth == 2, F.lit("Old report")).otherwise(F.lit(fixed.REPORT_NAMES[0])).alias("report_name"),
                             F.when(nth == 3, F.lit(None).cast("string")).otherwise(F.col("unit")).alias("unit"))
    return columns, lines


@register("k1_k2_configuration", O.configuration_sql)
def k_configuration(spark, d):
    """Required fields and option lists of the report's columns and lines and of the declared cash ledgers."""
    columns, lines = _typed_in(spark, d)
    return _union([
        K.required(columns, "cf_columns", ["date1"]), K.required(lines, "report_lines", ["report_name"]),
        K.allowed_values(columns, "cf_columns", {"month": fixed.MONTHS, "col_status": fixed.COLUMN_STATUSES}),
        K.allowed_values(lines, "report_lines", {"report_name": [*fixed.REPORT_NAMES, ""]}),
        K.allowed_values(fx.cash_ledger(spark, d, True), "cf_inflow", {"type": fixed.CF_INFLOW_TYPES}),
        K.allowed_values(fx.cash_ledger(spark, d, False), "cf_outflow", {"type": fixed.CF_OUTFLOW_TYPES, "account": fixed.CF_OUTFLOW_ACCOUNTS})])


@register("k3_configuration_defaults", O.configuration_defaults_sql)
def k3_configuration(spark, d):
    """Rows by the value of a field after its default was filled in: the ledgers' currency, the lines' unit."""
    parts = []
    for name, ledger in _ledgers(spark, d).items():
        typed = ledger.select(F.when(F.col("currency") != "USD", F.col("currency")).when(F.dayofmonth("expenses_date") > 15, F.col("currency")).alias("currency"))
        parts.append(K.with_defaults(typed, {"currency": fixed.DEFAULT_CURRENCY}).select(F.lit(name).alias("table"), F.col("currency").alias("value")))
    _, lines = _typed_in(spark, d)
    parts.append(K.with_defaults(lines, {"unit": fixed.DEFAULT_UNIT}).select(F.lit("report_lines").alias("table"), F.col("unit").alias("value")))
    return _union(parts).groupBy("table", "value").agg(F.count(F.lit(1)).alias("rows"))


@register("q12_import_gate_branches", O.q12_branches_sql)
def q12_branches(spark, d):
    """The gate of one upload against a target it reaches, one it misses, and of an empty one."""
    upload = IM.as_upload(fx.shipment_forecast(spark, d), fixed.FORECAST_UPLOAD_FIELDS)
    total = upload.agg(F.sum(F.col(f"`{fixed.FORECAST_QTY_HEADER}`")).alias("t")).scalar()
    gates = [("reached", upload, total), ("missed", upload, total + 1), ("empty", upload.limit(0), total)]
    return _union(IM.import_gate(u, fixed.FORECAST_QTY_HEADER, t).withColumn("case", F.lit(c)) for c, u, t in gates)


@register("q13_quantity_check_branches", O.q13_branches_sql)
def q13_branches(spark, d):
    """The quantity check against a target that is reached and one that is missed."""
    view = forecast_view(spark, d).select("quantity")
    total = view.agg(F.sum("quantity").alias("t")).scalar()
    return _union(IM.quantity_check(view, "quantity", t).withColumn("case", F.lit(c)) for c, t in (("reached", total), ("missed", total + 1)))


@register("p6_p7_text_amounts", O.text_amounts_sql)
def text_amounts(spark, d):
    """Bill amounts as text with a currency sign, some of them no number, read as numbers."""
    amount = F.col("total__fob_income").cast("decimal(20,2)").cast("string")
    text = F.when(F.pmod(F.col("invoice").cast("long"), F.lit(5)) == 0, F.concat(amount, F.lit(" approx"))).otherwise(F.concat(F.lit("$"), amount))
    rows = fx.bills_under_collection(spark, d).select("invoice", text.alias("amount_text"))
    return rows.select("invoice", S.strip_currency("amount_text").alias("bare"), S.number_of(rows, "amount_text").alias("amount"))


@register("p27_p28_dates_and_halves", O.dates_halves_sql)
def dates_halves(spark, d):
    """Whether month and day swap or day + 3 still make a calendar date; half valuation."""
    rows = fx.shipments(spark, d).select("amount", *(f("shipment_date").alias(n) for f, n in ((F.year, "y"), (F.month, "m"), (F.dayofmonth, "d"))))
    checks = rows.select("y", "m", "d", P.is_valid_date("y", "d", "m").alias("swapped"),
                         P.is_valid_date("y", "m", F.col("d") + 3).alias("three_later"), S.half("amount").alias("half"))
    return checks.groupBy("y", "m", "d", "swapped", "three_later").agg(S.money_sum("half").cast("double").alias("half"))


@register("q15_shipment_weekly_early_handover", O.q15_handover_sql)
def q15_handover(spark, d):
    """The early split of a view that names the handover: rows handed over as BUC are left
    out (F2), and so are rows without one."""
    view = forecast_view(spark, d)
    mark = F.when(F.pmod("quantity", F.lit(3)) == 0, "BUC").when(F.pmod("quantity", F.lit(3)) == 1, "Factory")
    return FC.early_weekly_split(view.withColumn("considerable_handover", mark), "amount", "r_day")


def _scratch(spark):
    return f"{checkpoint_dir(spark).rstrip('/')}/sinks-{uuid.uuid4().hex}"


@register("s5_s9_export_and_upload", O.export_upload_sql)
def export_upload(spark, d):
    """A delimited export (S9) of the bills upload, read back as an upload (S5) and mapped."""
    upload = IM.as_upload(fx.bills_under_collection(spark, d), fixed.BILLS_UPLOAD_FIELDS)
    at = sinks.export_sheet(upload, _scratch(spark))
    return IM.map_upload(sheets.read_upload(spark, at, upload.schema), fixed.BILLS_UPLOAD_FIELDS).select("invoice", "buyer", "ex_fty_date")


@register("s6_s7_s8_replace_and_append", O.sinks_sql)
def replace_append(spark, d):
    """Replace (S6, S8) a table, append (S7) to it, and replace it by a frame over itself."""
    t = fx.shipments(spark, d).select("shipment_date", "quentity")
    at = sinks.replace_table(t, _scratch(spark))
    sinks.replace_table(t.where("quentity > 10"), at)
    sinks.append_rows(t.where("quentity <= 5"), at)
    sinks.replace_from_itself(spark.read.parquet(at).groupBy("shipment_date").agg(
        F.count("*").alias("n"), S.money_sum("quentity").cast("double").alias("quentity")), at)
    return spark.read.parquet(at)


@register("s4_sheet_file_region", lambda: O.regions_sql("Act Expenses", "actual_expenses"))
def sheet_file(spark, d):
    """A region read from a delimited sheet export."""
    region = RS.region_of("actual_expenses")
    raw = fx.sheet_export(spark, d, region[1], region[2])
    back = sheets.read_sheet(spark, sinks.export_sheet(raw, _scratch(spark)), raw.schema)
    return RS.load_region(back, RS.header_of(back, region), region).withColumn("table", F.lit(region[0]))


def _raw_sheet(spark, d, sheet, header_row):
    """The sheet as a plain delimited file: nothing but its cells in order, the rows above the header empty,
    and a line break in each label."""
    raw = fx.sheet_export(spark, d, sheet, header_row)
    above = spark.range(header_row).select(F.col("id").cast("int").alias("row_no"), *[F.lit("").alias(c) for c in raw.columns[1:]])
    label = F.when(F.col("row_no") > header_row, F.replace("c2", F.lit("/"), F.lit("/\n"))).otherwise(F.col("c2"))
    cell = lambda c: F.concat(F.lit('"'), F.coalesce(c, F.lit("")), F.lit('"'))
    line = F.concat_ws(",", *[cell(label if c == "c2" else F.col(c)) for c in raw.columns[1:]])
    at = _scratch(spark)
    above.unionByName(raw).orderBy("row_no").select(line.alias("value")).coalesce(1).write.text(at)    # one sheet, one file
    return at, len(raw.columns) - 1


@register("s4_raw_sheet_file", lambda: O.regions_sql("Act Expenses"))
def raw_sheet_file(spark, d):
    """The actual-expense regions cut from plain delimited files: rows are numbered by their place
    in the file, labels go over two lines."""
    parts = []
    for region in (r for r in fixed.SHEET_REGIONS if r[1] == "Act Expenses"):
        raw = sheets.read_raw_sheet(spark, *_raw_sheet(spark, d, "Act Expenses", region[2]))
        long = RS.load_region(raw, RS.header_of(raw, region), region)
        parts.append(long.withColumns({"Descriptio": F.replace("Descriptio", F.lit("\n"), F.lit("")), "table": F.lit(region[0])}))
    return _union(parts)


def _faulty_lines(bills):
    """The bills as lines of a delimited upload, some of them broken: a field short, a quote left open,
    text for a number or a date."""
    k = F.col("invoice").cast("long")
    amount = F.col("total__fob_income").cast("decimal(20,2)").cast("string")
    amount = F.when(F.pmod(k, F.lit(11)) == 0, F.concat(amount, F.lit(" pcs"))).otherwise(F.concat(F.lit("$"), amount))
    day = F.when(F.pmod(k, F.lit(13)) == 0, F.lit("soon")).otherwise(F.date_format("ex_fty_date", "yyyy-MM-dd"))
    buyer = F.when(F.pmod(k, F.lit(7)) == 0, F.concat(F.lit('"'), F.col("buyer"))).otherwise(F.concat(F.lit('"'), F.col("buyer"), F.lit(", Ltd\"")))
    whole = F.concat_ws(",", "invoice", buyer, amount, day)
    return bills.select(F.when(F.pmod(k, F.lit(17)) == 0, F.concat_ws(",", "invoice", buyer, amount)).otherwise(whole).alias("value"))


@register("s5_upload_rejects", O.rejects_sql)
def upload_rejects(spark, d):
    """An upload with broken lines: the good rows typed, the others with the reason each was put aside."""
    schema = T.StructType([T.StructField("invoice", T.StringType()), T.StructField("buyer", T.StringType()),
                           T.StructField("amount", T.DoubleType()), T.StructField("day", T.DateType())])
    lines = _faulty_lines(fx.bills_under_collection(spark, d))
    at = _scratch(spark)
    # every file of the upload has its header
    headed = lines.withColumn("p", F.spark_partition_id())
    head = headed.select("p").distinct().select(F.lit("invoice,buyer,amount,day").alias("value"), "p", F.lit(0).alias("k"))
    both = headed.withColumn("k", F.lit(1)).unionByName(head).repartition("p").sortWithinPartitions("p", "k")
    both.select("value", "p").write.partitionBy("p").text(at)
    good, bad = sheets.read_upload_checked(spark, at, schema)
    why = F.array_join(F.transform("problems", lambda p: F.concat_ws(": ", p["field"], p["reason"])), "; ")
    bad = bad.select(F.substring_index("text", ",", 1).alias("invoice"), *(F.lit(None).cast(t).alias(c) for c, t in (("buyer", "string"), ("amount", "double"), ("day", "date"))),
                     why.alias("problems"))
    return good.withColumn("problems", F.lit("")).unionByName(bad)


@register("a10_forecast_totals", O.forecast_totals_sql)
def forecast_totals(spark, d):
    """Forecast report with totals by bank and over all (grouping sets)."""
    return RP.forecast_totals(FC.shipment_forecast_report(fx.shipment_forecast(spark, d), terms(spark, d)))


@register("k6_id_series", lambda: O.k6_sql("BUC%08d"))
def k6(spark, d):
    """Gap-free formatted ids for whole bills in (ex-factory date, invoice) order."""
    return K.id_series(fx.bills_under_collection(spark, d), ["ex_fty_date", "invoice"], "BUC%08d")


@register("w2_full_report", O.w2_sql)
def w2(spark, d):
    """Whole report rebuild: base cells + balance chain + roll-up totals."""
    return RP.full_report(RP.inputs_from_dir(spark, d))


#: Two more levels over the built-in totals: lines, and members with their sign.
GROUP_LINES = [("CFRL0301", "Group", "9", "Group cash", "BDT", 301), ("CFRL0302", "Group", "9", "Company cash", "BDT", 302)]
GROUP_MEMBERS = [("CFRL0301", "CFRL0183", 1), ("CFRL0301", "CFRL0192", 1), ("CFRL0302", "CFRL0301", 1), ("CFRL0302", "CFRL0147", -1)]


@register("t14_totals_of_member_table", lambda: O.members_sql(GROUP_LINES, GROUP_MEMBERS))
def t14_members(spark, d):
    """Totals of totals, four levels deep, by a table of members whose levels the operator finds."""
    built_in = R.members(spark).select("total_line", "member_line", "sign")
    more = TB.local_frame(spark, GROUP_MEMBERS, "total_line string, member_line string, sign int")
    at = sinks.replace_table(built_in.unionByName(more), f"{_scratch(spark)}/roll_up_members.parquet")
    inp = RP.inputs_from_dir(spark, d)
    inp.lines = inp.lines.unionByName(TB.local_frame(spark, GROUP_LINES, TB.LINES_SCHEMA))
    inp.members = spark.read.parquet(at)
    return RP.totals(inp)


@register("w1_versioned_import", O.versions_sql)
def w1_versions(spark, d):
    """The forecast as a versioned table after three imports (and one of them run again): every
    import writes one partition, older rows are Inactive by their version. An upload is read twice, for
    its content and its rows, so the uploads come from the stored version 0: the forecast's joins run once."""
    at = V.create(fx.shipment_forecast(spark, d), _scratch(spark))
    table = V.current(spark, at).drop("version")
    same = IM.as_upload(table, fixed.FORECAST_UPLOAD_FIELDS)
    for upload in (changed(table), same, same, changed(table)):
        V.import_upload(upload, at)
    return V.history(spark, at)


@register("s7_append_batches", O.append_batches_sql)
def append_batches(spark, d):
    """Two batches appended (S7), the first of them twice."""
    t = fx.shipments(spark, d).select("shipment_date", "quentity")
    at = _scratch(spark)
    for rows, batch in ((t.where("quentity <= 5"), "small"), (t.where("quentity > 45"), "large"), (t.where("quentity <= 5"), "small")):
        V.append_batch(rows, at, batch)
    return spark.read.parquet(at)


@register("s10_settings_table", O.settings_sql)
def settings_table(spark, d):
    """Q4 from the cf_date of a settings table, which is that of the folder's own first day and 1,000 more."""
    forecast = fx.shipment_forecast(spark, d)
    row = forecast.agg(F.date_add(F.min("exfty_date"), 1000).alias("cf_date")).select(
        F.lit(fixed.DEFAULT_SETTINGS["usd_rate"]).cast("double").alias("usd_rate"), "cf_date", F.lit(fixed.YEARLY_SHIPMENT_TARGET).cast("double").alias("yearly_shipment_qty_akl"))
    at = _scratch(spark)
    sinks.replace_table(row, f"{at}/settings.parquet")
    cf = TB.setting(spark, "cf_date", TB.optional_table(spark, at, "settings"))
    return FC.shipment_forecast_weekly(FC.active_shipment_forecast(forecast, terms(spark, d)), from_date=cf)


def _corrections(rows, day):
    """Rows booked late, corrected and deleted: (inserted, deleted)."""
    d, year = F.dayofmonth(day), F.year(day) == 1997
    gone, wrong = year & (d == 5) & (F.col("amount") < 500), year & (d == 6)
    late = rows.where(year & (d == 8)).withColumn(day, F.date_sub(day, 40))
    return rows.where(wrong).withColumn("amount", F.col("amount") * 2).unionByName(late), rows.where(gone | wrong)


@register("w2_incremental_report", O.incremental_sql)
def w2_incremental(spark, d):
    """The report after corrections of two ledgers, by a step upon the stored state: sums and cells
    of the columns they touch, the chain from there on."""
    inp, at = RP.inputs_from_dir(spark, d), _scratch(spark)
    INC.build(inp, at)
    parts = []
    for source in ("income_actual", "expenses_actual"):
        parts.append([RU.ledger_view(x, source) for x in _corrections(inp.tables[source], "expenses_date")])
    inserted, deleted = (_union(p[k] for p in parts) for k in (0, 1))
    return INC.apply(inp, at, INC.signed_sums(inserted, deleted))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: e.build for k, e in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: e.sql() for k, e in REGISTRY.items() if e.sql is not None}
