"""Roll-up totals, closing balances and group totals (Q2: J5, A6, A7, F8, P18;
A8, J9, W3).

Totals sum stored cells of member lines in the same column; closings are
signed nets (inflows - outflows). Both keep positive results only, rounded to
whole units. Totals of totals are evaluated level by level, because each level
is rounded and filtered before the next one reads it.

``mode='literal'`` reproduces the workbook as written: member ids spelt
``CCFRL`` match nothing, a total name used twice takes the last list for every
line with that name, and the column window is compared as text (so a one-day
column excludes its own cells). ``mode='repaired'`` (default) fixes the ids,
gives each same-named total line its own list and compares dates inclusively.

Membership is a table (total_line, member_line, sign), ``roll_up_members`` of the data folder;
without one the built-in lists serve, whose levels are known. ``with_levels`` finds the level of each
total of a table by peeling: totals of which no member is a total are the first
level, those whose total members are all placed the next. Totals that hold each
other are an error.

All inputs here are report cells (lines x columns), small by construction.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions import scalars as S
from .rules import CELL_COLUMNS
from ..session import materialize
from ..sources.tables import local_frame

MEMBERS_SCHEMA = "total_line string, member_line string, sign int, level int"


def _line_id(n: int) -> str:
    return fixed.LINE_ID_FORMAT % n


def member_rows(mode: str = "repaired", closings: bool = True) -> list[tuple[str, str, int, int]]:
    """(total line id, member line id, sign, level) for totals and, when
    ``closings``, the closing-balance formulas."""
    by_name: dict[str, list[int]] = {}
    for n, _r, _g, name, _u in fixed.REPORT_LINES:
        by_name.setdefault(name, []).append(n)
    assigned: dict[int, list[str]] = {}
    seen: dict[str, int] = {}
    for name, members in fixed.TOTALS_AS_WRITTEN:
        ids = by_name.get(name, [])
        if mode == "literal":
            for n in ids:                       # every same-named line; last list wins
                assigned[n] = list(members)
        else:
            i = seen.get(name, 0)
            seen[name] = i + 1
            if i < len(ids):
                assigned[ids[i]] = [re.sub(r"^C(CFRL)", r"\1", m) for m in members]
    rows: list[tuple[str, str, int]] = []
    for n, members in assigned.items():
        rows += [(_line_id(n), m, 1) for m in members]
    for closing, opening, plus, minus in (fixed.CLOSINGS if closings else []):
        rows += [(_line_id(closing), _line_id(m), 1) for m in [opening] + plus]
        rows += [(_line_id(closing), _line_id(m), -1) for m in minus]
    totals = {t for t, _, _ in rows}
    level: dict[str, int] = {}

    def lvl(t: str) -> int:
        if t not in level:
            level[t] = 1 + max((lvl(m) if m in totals else 0)
                               for tt, m, _ in rows if tt == t)
        return level[t]
    return [(t, m, s, lvl(t)) for t, m, s in rows]


def members(spark: SparkSession, mode: str = "repaired", closings: bool = True) -> DataFrame:
    """The built-in membership as a table (total_line, member_line, sign, level)."""
    return local_frame(spark, member_rows(mode, closings), MEMBERS_SCHEMA)


def with_levels(mem: DataFrame) -> tuple[DataFrame, int]:
    """A membership table (total_line, member_line, sign) with each total's ``level``, and the
    number of levels. A round of joins for each level, over the membership only; the number
    of totals left comes to the driver. Raises on totals that hold each other."""
    mem = materialize(mem.select("total_line", "member_line", "sign"))
    left = mem.select("total_line").distinct()
    inner = mem.join(left.select(F.col("total_line").alias("member_line")), "member_line", "left_semi").select("total_line", "member_line")
    placed, level, rest = None, 0, left.count()
    while rest:
        level += 1
        waiting = inner.join(left.select(F.col("total_line").alias("member_line")), "member_line", "left_semi").select("total_line").distinct()
        now = left.join(waiting, "total_line", "left_anti")
        left = materialize(left.join(waiting, "total_line", "left_semi"))
        placed = now.withColumn("level", F.lit(level)) if placed is None else placed.unionByName(now.withColumn("level", F.lit(level)))
        before, rest = rest, left.count()
        if rest == before:
            names = [r[0] for r in left.orderBy("total_line").limit(10).collect()]
            raise ValueError(f"totals that hold each other, or that hold such: {', '.join(names)}")
    if placed is None:
        return mem.withColumn("level", F.lit(0)), 0
    return materialize(mem.join(placed, "total_line")), level


def _in_window(mode: str):
    d, a, b = F.col("ex_date"), F.col("date1"), F.col("date2")
    return (d > a) & (d <= b) if mode == "literal" else d.between(a, b)


def _roll_level(cells: DataFrame, mem: DataFrame, lines: DataFrame, columns: DataFrame,
                mode: str) -> DataFrame:
    cols = columns.select(F.col("name").alias("report_col"), "date1", "date2")
    c = cells.select("report_line", "report_col", "ex_date", "amount").join(cols, "report_col")
    c = c.where(_in_window(mode))
    j = c.join(mem, c.report_line == mem.member_line)
    agg = (j.groupBy("total_line", "report_col")
           .agg(F.sum(S.money(F.col("amount")) * F.col("sign")).alias("v"))
           .where(F.col("v") > 0))
    info = columns.select(F.col("name").alias("report_col"), F.col("col_no").alias("col_index"),
                          F.col("date2").alias("ex_date"), "month")
    ln = lines.select(F.col("name").alias("total_line"), "line_name",
                      (F.lit(None).cast("string") if mode == "literal" else F.col("group_no"))
                      .alias("group_no"))
    return (agg.join(info, "report_col").join(ln, "total_line")
            .select(F.col("total_line").alias("report_line"), "report_col", "col_index", "ex_date",
                    "month", "line_name", "group_no", S.round_cell("v", 0).alias("amount")))


def totals_and_closings(cells: DataFrame, lines: DataFrame, columns: DataFrame,
                        mode: str = "repaired", closings: bool = True, mem: DataFrame | None = None) -> DataFrame:
    """Q2: totals and closing balances from stored cells, level by level.
    Returns only the new rows (same schema as the cells). ``closings=False``
    when the cells already hold closing balances (from the balance chain).
    ``mem``: a membership table of any depth instead of the built-in lists."""
    if mem is None:
        levelled, levels = members(cells.sparkSession, mode, closings), max(r[3] for r in member_rows(mode, closings))
    else:
        levelled, levels = with_levels(mem)
    out = None
    current = cells.select(*CELL_COLUMNS)
    for level in range(1, levels + 1):
        own = levelled.where(F.col("level") == level).drop("level")
        new = _roll_level(current, own, lines, columns, mode)
        out = new if out is None else out.unionByName(new)
        current = current.unionByName(new)
    return current.limit(0) if out is None else out


# --- A8 / J9 / W3 ---------------------------------------------------------------------
def group_totals(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """Per (group_no, column) the sum of stored cells inside the column's
    date window."""
    cols = columns.select(F.col("col_no").alias("col_index"), "date1", "date2")
    c = cells.join(cols, "col_index").where(F.col("ex_date").between(F.col("date1"), F.col("date2")))
    return (c.where(F.col("group_no").isNotNull())
            .groupBy("group_no", "col_index")
            .agg(S.money_sum("amount").cast("double").alias("amount")))


def replace_group_line(cells: DataFrame, columns: DataFrame, lines: DataFrame,
                       line_name: str, group_no: str) -> DataFrame:
    """Per (line, column), delete the stored cell of ``line_name`` where the
    group has a total in that column (J9, an anti join on both) and append the
    total of ``group_no`` over the group's other cells under the line's id(s).
    Cells of the line in columns without a total stay."""
    cells = cells.select(*CELL_COLUMNS)
    others = cells.where(~F.col("line_name").eqNullSafe(F.lit(line_name)))
    totals = group_totals(others, columns).where(F.col("group_no") == group_no)
    info = columns.select(F.col("col_no").alias("col_index"), F.col("name").alias("report_col"),
                          F.col("date2").alias("ex_date"), "month")
    named = lines.where(F.col("line_name") == line_name).select(F.col("name").alias("report_line"), "line_name")
    fresh = _under(totals.join(info, "col_index"), named)
    kept = cells.join(fresh.select("report_line", "report_col"), ["report_line", "report_col"], "left_anti")
    return kept.select(*CELL_COLUMNS).unionByName(fresh)


def _under(totals: DataFrame, named: DataFrame) -> DataFrame:
    """Each total under each of the line's ids (a handful, as a scalar subquery)."""
    ids = named.agg(F.collect_list(F.struct("report_line", "line_name")).alias("l")).scalar()
    rows = totals.withColumn("l", F.explode(ids))
    return rows.select("*", "l.report_line", "l.line_name").select(*CELL_COLUMNS)
