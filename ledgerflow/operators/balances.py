"""Opening balances and the account balance chain (Q3: J6, P15).

Literal openings (``opening_balances``): the opening of an account in column
n is the stored closing of that account in column ``n - 2`` (the previous
column of the same status when statuses alternate), looked up inside the
column's window moved back 7 days -- so a 0-3 day last bucket of a month
misses its predecessor, as the workbook does. The "Total Opening Balance"
line of that pass fails in the workbook (a number joined to text) and is not
produced.

Repaired chain (``balance_roll_forward``): per account and status, columns in
date order, ``closing_n = max(0, closing_{n-1} + net_n)`` and
``opening_n = closing_{n-1}``. The clamp is what storing only positive cells
does. Without a loop: with ``S_n = opening_0 + running sum(net)`` and
``M_n = running min(S)``, ``closing_n = S_n - least(0, M_n)``. Two window
expressions over one partitioning (account, status), each partition holding
one row per report column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import fixed
from ..functions import scalars as S
from . import intervals as I
from .rules import CELL_COLUMNS
from ..sources.tables import local_frame


def _line_id(n: int) -> str:
    return fixed.LINE_ID_FORMAT % n


def opening_map_rows() -> list[tuple[str, str]]:
    """(opening line id, closing line id) per account."""
    return [(_line_id(o), _line_id(c)) for c, o, _p, _m in fixed.CLOSINGS]


def opening_balances(cells: DataFrame, lines: DataFrame, columns: DataFrame,
                     shift_days: int = fixed.OPENING_SHIFT_DAYS) -> DataFrame:
    """Q3 as written: openings from the closing cells of column ``n - 2``."""
    spark = cells.sparkSession
    omap = local_frame(spark, opening_map_rows(), "open_line string, close_line string")
    cols = columns.select(F.col("name").alias("report_col"), F.col("col_no").alias("col_index"),
                          F.col("date1"), F.col("date2"), "month")
    prev = cells.select(F.col("report_line").alias("close_line"),
                        F.col("col_index").alias("prev_index"),
                        F.col("ex_date").alias("prev_ex_date"), F.col("amount"))
    prev = prev.join(omap, "close_line")
    j = prev.join(cols, prev.prev_index == cols.col_index - 2)
    lo, hi = F.date_sub("date1", shift_days), F.date_sub("date2", shift_days)
    j = j.where((F.col("prev_ex_date") > lo) & (F.col("prev_ex_date") <= hi))   # text-style window
    agg = (j.groupBy("open_line", "report_col", "col_index", "date2", "month")
           .agg(S.money_sum("amount").alias("v")).where(F.col("v") > 0))
    ln = lines.select(F.col("name").alias("open_line"), "line_name")
    return (agg.join(ln, "open_line")
            .select(F.col("open_line").alias("report_line"), "report_col", "col_index",
                    F.col("date2").alias("ex_date"), "month", "line_name",
                    F.lit(None).cast("string").alias("group_no"),
                    S.round_cell("v", 0).alias("amount")))


def account_nets(cells: DataFrame) -> DataFrame:
    """Per (closing account, column): inflows - outflows of the column, the
    opening itself excluded."""
    spark = cells.sparkSession
    rows = []
    for closing, _opening, plus, minus in fixed.CLOSINGS:
        rows += [(_line_id(closing), _line_id(m), 1) for m in plus]
        rows += [(_line_id(closing), _line_id(m), -1) for m in minus]
    mem = local_frame(spark, rows, "account string, member_line string, sign int")
    j = cells.join(mem, cells.report_line == mem.member_line)
    return (j.groupBy("account", "report_col")
            .agg(F.sum(S.money(F.col("amount")) * F.col("sign")).alias("net")))


def chain(cells: DataFrame, columns: DataFrame, initial: DataFrame | None = None, clamp: bool = True) -> DataFrame:
    """The exact opening and closing of every account in every weekly column:
    (account, open_line, report_col, col_index, date1, date2, month, col_status, opening, closing).

    ``initial``: optional ``(account, col_status, opening)`` starting balances
    (account = closing line id); zero when absent. ``clamp=False`` gives the
    plain running balance."""
    spark = cells.sparkSession
    acc = local_frame(spark, [(_line_id(c), _line_id(o)) for c, o, _p, _m in fixed.CLOSINGS],
                                "account string, open_line string")
    cols = columns.where(~F.col("ismonth")).select(
        F.col("name").alias("report_col"), F.col("col_no").alias("col_index"), "date1", "date2",
        "month", "col_status")
    grid = cols.withColumn("account", F.explode(F.array(*[F.lit(_line_id(c))
                                                          for c, *_ in fixed.CLOSINGS])))
    g = grid.join(account_nets(cells), ["account", "report_col"], "left").withColumn(
        "net", F.coalesce(F.col("net"), S.money(F.lit(0))))
    if initial is not None:
        g = g.join(initial.select("account", "col_status", S.money(F.col("opening")).alias("start")),
                   ["account", "col_status"], "left")
    else:
        g = g.withColumn("start", F.lit(None).cast(S.MONEY))
    g = g.withColumn("start", F.coalesce(F.col("start"), S.money(F.lit(0))))
    w = (Window.partitionBy("account", "col_status").orderBy("date1", "col_index")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    g = g.withColumn("s", F.col("start") + F.sum("net").over(w))
    if clamp:
        g = g.withColumn("closing", F.col("s") - F.least(F.lit(0), F.min("s").over(w)))
    else:
        g = g.withColumn("closing", F.col("s"))
    order = Window.partitionBy("account", "col_status").orderBy("date1", "col_index")
    g = g.withColumn("opening", F.coalesce(F.lag("closing", 1).over(order), F.col("start")))
    return g.join(acc, "account").select("account", "open_line", "report_col", "col_index", "date1", "date2",
                                         "month", "col_status", "opening", "closing")


def chain_cells(weekly: DataFrame, lines: DataFrame, columns: DataFrame) -> DataFrame:
    """Report cells of a ``chain``: its weekly columns, and every whole-month column, which opens
    with its first week and closes with its last. Positive balances, rounded to
    whole units, as cells of the opening and closing lines."""
    months = columns.where(F.col("ismonth")).select(
        F.col("name").alias("m_col"), F.col("col_no").alias("m_index"), F.col("date1").alias("m1"),
        F.col("date2").alias("m2"), F.col("month").alias("m_month"), "col_status")
    inside = I.day_join(weekly, "date1", months, "m1", "m2", ["col_status"]).where("date2 <= m2")
    monthly = (inside.groupBy("account", "open_line", "m_col", "m_index", "m2", "m_month")
               .agg(F.min_by("opening", "date1").alias("opening"),
                    F.max_by("closing", "date2").alias("closing"))
               .select("account", "open_line", F.col("m_col").alias("report_col"),
                       F.col("m_index").alias("col_index"), F.col("m2").alias("date2"),
                       F.col("m_month").alias("month"), "opening", "closing"))
    bal = weekly.drop("date1", "col_status").unionByName(monthly)
    ln = lines.select(F.col("name").alias("report_line"), "line_name", "group_no")
    # one pass: each balance row yields its opening cell and its closing cell
    both = bal.select("report_col", "col_index", "date2", "month", F.explode(F.array(
        F.struct(F.col("open_line").alias("line"), F.col("opening").alias("v")),
        F.struct(F.col("account").alias("line"), F.col("closing").alias("v")))).alias("e"))
    return (both.where(F.col("e.v") > 0)
            .select(F.col("e.line").alias("report_line"), "report_col", "col_index",
                    F.col("date2").alias("ex_date"), "month",
                    S.round_cell(F.col("e.v"), 0).alias("amount"))
            .join(ln, "report_line").select(*CELL_COLUMNS))


def balance_roll_forward(cells: DataFrame, lines: DataFrame, columns: DataFrame,
                         initial: DataFrame | None = None, clamp: bool = True) -> DataFrame:
    """Opening and closing cells of every account in every weekly and whole-month column
    (``chain``, ``chain_cells``)."""
    return chain_cells(chain(cells, columns, initial, clamp), lines, columns)
