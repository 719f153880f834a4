"""Report base cells from declarative rules (Q1: J3, J4, A3-A5, P17-P19, F8).

A rule says: for report line L in columns of status S, sum measure M of
source V over rows whose trimmed match column (head or account) equals key K
and whose date lies in the column's [date1, date2].

Plan, whatever the ledger size:
1. ledger rows are summed per (source, head, account, day) -- a partial
   aggregate in the scan stage, so the shuffle carries at most keys x days
   rows per task and a hot key costs nothing extra; the sums are then keyed
   by head and by account, and keys no rule reads are dropped;
2. the key sums, added up per dyadic block of days (``intervals``), join rules x lines on
   (source, match column, key);
3. and the report columns on (status, level, block), each column standing for the at most
   2 log2(days) blocks of its range, so the date range is an equi join whatever
   its length; one more sum gives the cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import scalars as S
from . import intervals as I

CELL_COLUMNS = ["report_line", "report_col", "col_index", "ex_date", "month", "line_name",
                "group_no", "amount"]


# --- ledger views (the report's sources) ---------------------------------------------
def in_window(day: str, week: str | None, window) -> Column:
    """``coalesce(week, day)`` inside ``window`` (inclusive), written on the
    raw columns so the Parquet reader can skip row groups by their stats."""
    lo, hi = window
    d = F.col(day).cast("date").between(lo, hi)
    if not week:
        return d
    w = F.col(week)
    return (w.isNotNull() & w.cast("date").between(lo, hi)) | (w.isNull() & d)


def ledger_view(df: DataFrame, source: str, head: str | Column = "expenses_head",
                account: str | Column | None = "main_account", day: str = "expenses_date",
                week: str | None = "week_date", measure: str = "amount",
                window=None) -> DataFrame:
    """One source as rows ``(source, Descriptio, account, variable, amount)``;
    ``variable`` is the week date when given, else the booking date.
    ``window=(lo, hi)`` keeps only rows whose ``variable`` falls inside it."""
    has_week = bool(week and week in df.columns)
    variable = F.coalesce(F.col(week), F.col(day)) if has_week else F.col(day)
    if window is not None:
        df = df.where(in_window(day, week if has_week else None, window))
    acc = F.lit(None).cast("string") if account is None else S.col(account)
    return df.select(F.lit(source).alias("source"), S.col(head).alias("Descriptio"),
                     acc.alias("account"), variable.cast("date").alias("variable"),
                     F.col(measure).cast("double").alias("amount"))


def shipment_views(shipments: DataFrame, window=None) -> DataFrame:
    """Actual shipments as two sources, quantity and FOB value, from one scan:
    every shipment row yields its quantity row and its value row."""
    actual = shipments.where(F.col("shipment_type") == "Actual")
    has_week = "week_date" in actual.columns
    if window is not None:
        actual = actual.where(in_window("shipment_date", "week_date" if has_week else None, window))
    variable = (F.coalesce(F.col("week_date"), F.col("shipment_date")) if has_week
                else F.col("shipment_date"))
    pairs = F.explode(F.array(
        F.struct(F.lit("shipments_qty").alias("source"), F.lit("Shipped Qty").alias("Descriptio"),
                 F.col("quentity").cast("double").alias("amount")),
        F.struct(F.lit("shipments_fob").alias("source"), F.lit("Shipped FOB").alias("Descriptio"),
                 F.col("amount").cast("double").alias("amount"))))
    return (actual.select(variable.cast("date").alias("variable"), pairs.alias("p"))
            .select("p.source", "p.Descriptio", F.lit(None).cast("string").alias("account"),
                    "variable", "p.amount"))


def projected_income_view(final_proj_income: DataFrame, window=None) -> DataFrame:
    return ledger_view(final_proj_income, "final_proj_income", "Descriptio", None, "variable",
                       None, "value", window)


def report_sources(income_forecast: DataFrame, income_actual: DataFrame,
                   expenses_forecast: DataFrame, expenses_actual: DataFrame,
                   shipments: DataFrame, final_proj_income: DataFrame,
                   window=None) -> DataFrame:
    """All report sources as one long frame; ``window=(lo, hi)`` (the span of
    the report's columns) drops rows no column can use before any shuffle."""
    return (ledger_view(income_forecast, "income_forecast", window=window)
            .unionByName(ledger_view(income_actual, "income_actual", window=window))
            .unionByName(ledger_view(expenses_forecast, "expenses_forecast", window=window))
            .unionByName(ledger_view(expenses_actual, "expenses_actual", window=window))
            .unionByName(shipment_views(shipments, window))
            .unionByName(projected_income_view(final_proj_income, window)))


def column_span(columns: DataFrame):
    """(first date1, last date2) of the report columns, as scalar subqueries."""
    span = columns.agg(F.min("date1").alias("lo"), F.max("date2").alias("hi"))
    return span.select("lo").scalar(), span.select("hi").scalar()


# --- compiler -----------------------------------------------------------------------
def keyed(rows: DataFrame, *kept: str) -> DataFrame:
    """Each row by its trimmed head and by its trimmed account."""
    pairs = F.explode(F.array(F.struct(F.lit("head").alias("dim"), F.col("head").alias("key")),
                              F.struct(F.lit("account").alias("dim"), F.col("account").alias("key"))))
    out = rows.select("source", pairs.alias("k"), *kept).where(F.col("k.key").isNotNull())
    return out.select("source", F.col("k.dim").alias("dim"), F.col("k.key").alias("key"), *kept)


def daily_sums(sources: DataFrame) -> DataFrame:
    """Exact sums per (source, trimmed head, trimmed account, day): a partial aggregate in the
    scan stage, so a hot key or day is one row of each task."""
    return (sources.groupBy("source", S.trimmed("Descriptio").alias("head"), S.trimmed("account").alias("account"), "variable")
            .agg(S.money_sum("amount").alias("amount")))


def block_key_sums(sums: DataFrame, rules: DataFrame, top) -> DataFrame:
    """Step 1: the daily sums of the keys that rules read, told apart by key and added up
    per (source, dim, key) and block of days, up to level ``top``."""
    used = rules.select("source", "dim", S.trimmed("key").alias("key")).distinct()
    rows = keyed(sums, "variable", "amount").join(used, ["source", "dim", "key"], "left_semi")
    return (I.with_day_blocks(rows, "variable", top).groupBy("source", "dim", "key", "level", "block")
            .agg(F.sum("amount").cast(S.MONEY).alias("amount")))


def rule_lines(rules: DataFrame, lines: DataFrame) -> DataFrame:
    """Step 2: one row per (rule, report line of its name)."""
    r = rules.select("col_status", S.trimmed("line_name").alias("rule_line"), "source", "dim",
                     S.trimmed("key").alias("key"), "scale")
    ln = lines.select(F.col("name").alias("report_line"), "line_name", "group_no",
                      S.trimmed("line_name").alias("rule_line"))
    return r.join(ln, "rule_line").drop("rule_line")


def column_blocks(columns: DataFrame) -> DataFrame:
    """Step 3: each report column for each block of days of its range."""
    return I.indexed(columns.select(F.col("name").alias("report_col"), F.col("col_no").alias("col_index"), "month", "date1", "date2", "col_status"),
                     "date1", "date2").drop("date1")


def base_cells(sources: DataFrame, rules: DataFrame, lines: DataFrame, columns: DataFrame,
               usd_rate=fixed.DEFAULT_SETTINGS["usd_rate"], digits: int = 3) -> DataFrame:
    """Q1: stored report cells -- positive sums only, rounded to ``digits``.
    ``usd_rate``: a number or a Column (the settings row as a scalar subquery)."""
    return cells_of(daily_sums(sources), rules, lines, columns, usd_rate, digits)


def cells_of(sums: DataFrame, rules: DataFrame, lines: DataFrame, columns: DataFrame,
             usd_rate=fixed.DEFAULT_SETTINGS["usd_rate"], digits: int = 3) -> DataFrame:
    """Q1 from daily sums (``daily_sums``)."""
    blocks = column_blocks(columns)
    keyed_sums = block_key_sums(sums, rules, I.top_level(blocks))
    hit = keyed_sums.join(rule_lines(rules, lines), ["source", "dim", "key"]).join(blocks, ["col_status", "level", "block"])
    keys = ["report_line", "report_col", "col_index", "date2", "month", "line_name", "group_no",
            "scale"]
    summed = hit.groupBy(*keys).agg(F.sum("amount").alias("s"))
    value = (F.when(F.col("scale") == "usd_per_thousand",
                    S.money(S.usd_per_thousand(F.col("s").cast("double"), S.value(usd_rate).cast("double"))))
             .otherwise(F.col("s")))
    return (summed.withColumn("v", value).where(F.col("v") > 0)
            .select("report_line", "report_col", "col_index", F.col("date2").alias("ex_date"),
                    "month", "line_name", "group_no",
                    S.round_cell("v", digits).alias("amount")))


# --- linter ------------------------------------------------------------------------
def unmatched_rules(rules: DataFrame, sources: DataFrame) -> DataFrame:
    """Rules whose (source, match column, key) never occurs in the data: their
    cells can only ever be zero (a misspelt key, or a key from another list)."""
    heads = sources.select("source", S.trimmed("Descriptio").alias("head"), S.trimmed("account").alias("account")).distinct()
    r = rules.select("col_status", "line_name", "source", "dim", S.trimmed("key").alias("key"))
    return r.join(keyed(heads).distinct(), ["source", "dim", "key"], "left_anti")


def rules_outside_options(rules: DataFrame, options: DataFrame) -> DataFrame:
    """Rules whose trimmed key is not in the closed option list of the column
    they match (``options``: source, dim, value). Sources without a declared
    list (shipments, projected income) are not judged."""
    judged = options.select("source", "dim").distinct()
    opts = options.select("source", "dim", S.trimmed("value").alias("key"))
    r = rules.select("col_status", "line_name", "source", "dim", S.trimmed("key").alias("key"))
    return (r.join(F.broadcast(judged), ["source", "dim"])
            .join(F.broadcast(opts), ["source", "dim", "key"], "left_anti"))


def ledger_option_rows() -> list[tuple[str, str, str]]:
    """(source, dim, allowed value) from the ledgers' declared option lists."""
    lists = [("income_forecast", "head", fixed.INCOME_FORECAST_HEADS),
             ("income_forecast", "account", fixed.INCOME_ACCOUNTS),
             ("income_actual", "head", fixed.INCOME_ACTUAL_HEADS),
             ("income_actual", "account", fixed.INCOME_ACCOUNTS),
             ("expenses_forecast", "head", fixed.EXPENSE_HEADS),
             ("expenses_forecast", "account", fixed.EXPENSE_ACCOUNTS),
             ("expenses_actual", "head", fixed.EXPENSE_HEADS),
             ("expenses_actual", "account", fixed.EXPENSE_ACCOUNTS)]
    return [(src, dim, v) for src, dim, values in lists for v in dict.fromkeys(values)]
