"""Domain tables presented over the driver's star-schema test tables.

Each function only renames and re-types columns of the driver tables into the
schema a domain table has (FIXTURES.md §2): arithmetic on keys, no randomness,
none of the operators' work. The same mapping is written as DuckDB SQL in
``plans/oracle.py`` for the correctness check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import fixed
from ..operators.joins import dimension_join
from .tables import literal_array, read_table


def _date(c: str) -> Column:
    return F.col(c).cast("date")


def _pick(values: list[str], key: Column) -> Column:
    """values[key % len(values)] from a literal list."""
    return F.element_at(literal_array(values), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def buyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (c.join(n, c.c_nationkey == n.n_nationkey)
            .select(F.col("c_name").alias("buyer_name"),
                    (F.lit(15) * F.pmod("c_custkey", F.lit(5)) + 30).cast("int").alias("realised_day"),
                    F.col("n_name").alias("bank")))


def buyer_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buyers with the record's own name, as the buyer list shows them."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").cast("string").alias("name"), F.col("c_name").alias("buyer_name"), F.col("n_name").alias("bank"))


def bank_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return read_table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("name"),
        (F.lit(10.0) * F.pmod(k, F.lit(5))).alias("margin"),
        (F.lit(5.0) + F.pmod(k, F.lit(3))).alias("bildup_unifill"),
        F.lit(50.0).alias("erq"),
        (F.lit(2.0) * F.pmod(k, F.lit(4))).alias("bildup_machine"),
        (F.lit(20.0) + F.pmod(k, F.lit(7))).alias("bildup_regular"))


def shipment_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    # the buyer comes to the orders first, so the lines, of which there are most, are dealt and sorted once
    orders = o.count()
    o = dimension_join(o, c, ["o_custkey"], ["c_custkey"]).select("o_orderkey", "c_name")
    return (dimension_join(li, o, ["l_orderkey"], ["o_orderkey"], dim_rows=orders)
            .select(F.col("c_name").alias("buyer"),
                    F.col("l_partkey").cast("string").alias("style"),
                    F.col("l_orderkey").cast("string").alias("po_no"),
                    F.lit(None).cast("string").alias("color"),
                    F.lit(None).cast("string").alias("team"),
                    F.lit(None).cast("string").alias("oc"),
                    price.alias("fobpc"),
                    F.col("l_quantity").alias("po_qty"),
                    price.alias("fob_price"),
                    F.col("l_quantity").alias("order_qty"),
                    F.lit(None).cast("double").alias("shipped_qty"),
                    _date("l_shipdate").alias("exfty_date"),
                    F.when(F.col("l_returnflag") == "R", "Inactive").otherwise("Active").alias("status")))


def bills_under_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    k = F.col("o_orderkey")
    d = _date("o_orderdate")

    def revised(mod: int, days: int) -> Column:
        return F.when(F.pmod(k, F.lit(mod)) == 0, F.date_add(d, days))

    status = (F.when(F.col("o_orderstatus") == "F", "FULLY REALIZED")
              .when(F.col("o_orderstatus") == "O", "OPEN")
              .when(F.pmod(k, F.lit(7)) == 0, F.lit(None).cast("string"))
              .otherwise("PENDING"))
    return (dimension_join(o, c, ["o_custkey"], ["c_custkey"])
            .select(k.cast("string").alias("invoice"),
                    F.col("c_name").alias("buyer"),
                    F.lit(None).cast("string").alias("style_no"),
                    k.cast("string").alias("po_no"),
                    F.lit(None).cast("double").alias("qty_pcs"),
                    F.lit(None).cast("double").alias("unit_price"),
                    F.col("o_totalprice").alias("total__fob_income"),
                    d.alias("ex_fty_date"),
                    revised(3, 10).alias("ex1"),
                    revised(6, 20).alias("ex2"),
                    revised(12, 30).alias("ex3"),
                    status.alias("status")))


def _ledger(spark: SparkSession, sf_dir: str, income: bool, forecast: bool) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount",
        "l_returnflag", "l_linestatus", "l_shipdate")
    li = li.where((F.col("l_linestatus") == ("O" if forecast else "F"))
                  & (F.pmod("l_linenumber", F.lit(2)) == (1 if income else 0)))
    if income:
        heads = fixed.INCOME_FORECAST_HEADS if forecast else fixed.INCOME_ACTUAL_HEADS
        accounts = fixed.INCOME_ACCOUNTS
    else:
        heads, accounts = fixed.EXPENSE_HEADS, fixed.EXPENSE_ACCOUNTS
    amount = F.col("l_extendedprice") * F.col("l_discount")
    cols = [_date("l_shipdate").alias("expenses_date"),
            _pick(accounts, F.col("l_partkey")).alias("main_account"),
            _pick(heads, F.col("l_partkey")).alias("expenses_head"),
            _pick(fixed.CURRENCIES, F.col("l_suppkey")).alias("currency"),
            F.when(F.col("l_returnflag") == "R", -amount).otherwise(amount).alias("amount")]
    if forecast or income:
        cols.append(F.lit(None).cast("date").alias("week_date"))
    return li.select(*cols)


def income_forecast(spark, sf_dir):
    return _ledger(spark, sf_dir, income=True, forecast=True)


def income_actual(spark, sf_dir):
    return _ledger(spark, sf_dir, income=True, forecast=False)


def expenses_forecast(spark, sf_dir):
    return _ledger(spark, sf_dir, income=False, forecast=True)


def expenses_actual(spark, sf_dir):
    return _ledger(spark, sf_dir, income=False, forecast=False)


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_linestatus", "l_shipdate")
    return li.select(
        _date("l_shipdate").alias("shipment_date"),
        F.when(F.col("l_linestatus") == "F", "Actual").otherwise("Projected").alias("shipment_type"),
        F.col("l_quantity").alias("quentity"),
        F.col("l_extendedprice").alias("amount"),
        F.lit(None).cast("date").alias("week_date"))


def cash_ledger(spark: SparkSession, sf_dir: str, inflow: bool) -> DataFrame:
    """The declared cash ledgers: one row per event, its type and account as they were typed in."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    types = fixed.CF_INFLOW_TYPES if inflow else fixed.CF_OUTFLOW_TYPES
    return ev.select(_pick([*types, "Planned"], F.col("user_id")).alias("type"), _pick([*fixed.CF_OUTFLOW_ACCOUNTS, "EUR"], F.col("event_id")).alias("account"),
                     F.col("event_type").alias("description"), _date("ts").alias("date"), F.col("value").alias("amount"), F.lit(False).alias("active"))


def column_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(first, last): the years of the booking dates, and one more for the receipts."""
    days = read_table(spark, sf_dir, "lineitem").select(_date("l_shipdate").alias("d")).unionAll(
        read_table(spark, sf_dir, "orders").select(_date("o_orderdate").alias("d")))
    return days.agg(F.year(F.min("d")).alias("first"), (F.year(F.max("d")) + 1).alias("last"))


def wide_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide planning sheet: one row per event type (``row_no`` by type) with its value
    columns as a map: for every day of the table that day's ``sum(value)``, null where the type
    has none, and the three quarter subtotal columns a sheet carries (Apr, May, Jun, null here)."""
    ev = read_table(spark, sf_dir, "events").select(
        F.col("event_type").alias("Description"), F.date_format(F.col("ts").cast("date"), "yyyy-MM-dd").alias("day"), "value")
    sums = ev.groupBy("Description", "day").agg(F.sum(F.col("value").cast("decimal(38,6)")).cast("double").alias("v"))
    own = sums.groupBy("Description").agg(F.map_from_entries(F.collect_list(F.struct("day", "v"))).alias("own"))   # a cell of the sheet each
    days = ev.agg(F.collect_set("day").alias("days")).select("days").scalar()
    rn = F.dense_rank().over(Window.orderBy("Description"))  # a handful of sheet rows
    rows = own.select(rn.cast("int").alias("row_no"), "Description", F.lit("USD").alias("Unit"), "own",
                      F.concat(days, F.array(*map(F.lit, ("Apr", "May", "Jun")))).alias("heads"))
    return rows.select("row_no", "Description", "Unit", F.map_from_arrays(
        "heads", F.transform("heads", lambda h: F.try_element_at("own", h))).alias("cells"))


#: Headers of the stand-in for a workbook sheet; the sheets with account columns in front
#: have a total before the months.
_MONTH_HEADS = [f"2024-{m:02d}-01 00:00:00" for m in range(1, 13)]
SHEET_HEADERS = {
    "Act Expenses": ["SL", "Account", "Summary", "Unit", "Total", *_MONTH_HEADS, "Apr", "May", "Jun"],
    "Proj. Expenses income": ["SL", "Account", "Summary", "Unit", "Total", *_MONTH_HEADS, "Apr", "May", "Jun"],
    "Bank Balance & Others": ["SL", "Account", "", "", *_MONTH_HEADS, "Apr", "May", "Jun"],
}


def sheet_export(spark: SparkSession, sf_dir: str, sheet: str, header_row: int) -> DataFrame:
    """A sheet as exported: the header in ``header_row`` and below it a row for each
    (event type, user mod 25), a text column for each sheet column. ``budget`` headers
    of the third block are blank, as in the workbook."""
    head = list(SHEET_HEADERS[sheet])
    if header_row == 108:
        head[2] = head[3] = ""
    ev = read_table(spark, sf_dir, "events").select(
        "event_type", F.pmod("user_id", F.lit(25)).cast("int").alias("g"), F.month(F.col("ts").cast("date")).alias("m"), "value")
    money = lambda c: F.sum(c.cast("decimal(38,6)")).cast("double")
    sums = ev.groupBy("event_type", "g").agg(
        *[money(F.when(F.col("m") == m, F.col("value"))).alias(f"m{m}") for m in range(1, 13)], money(F.col("value")).alias("total"))
    place = F.row_number().over(Window.orderBy("g", "event_type"))   # 25 rows for each event type
    values = {"SL": place.cast("string"), "Account": F.col("event_type"), "Total": F.concat(F.lit("$"), F.col("total").cast("string"))}
    values |= {h: F.col(f"m{k + 1}").cast("string") for k, h in enumerate(_MONTH_HEADS)}
    label = [F.concat_ws("/", "event_type", F.col("g").cast("string")), F.lit("USD")]
    cols = [label[k - 2] if k in (2, 3) else values.get(h, F.lit(None).cast("string")) for k, h in enumerate(head)]
    rows = sums.select((place + header_row).cast("int").alias("row_no"), *[c.alias(f"c{k}") for k, c in enumerate(cols)])
    top = spark.range(1).select(F.lit(header_row).cast("int").alias("row_no"),
                                *[(F.lit(h) if h else F.lit(None).cast("string")).alias(f"c{k}") for k, h in enumerate(head)])
    return top.unionByName(rows)
