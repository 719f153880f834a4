"""The report kept up to date by increments (W2 without a rebuild).

The state is a folder of Parquet tables to which every step only adds partitions:

* ``sums``: the exact daily key sums of the ledgers (source, head, account, day). Sums of
  decimals merge, so a step adds the signed sums of what was booked, corrected
  (the old row out, the new one in) or deleted, and the ledgers themselves are never read again;
* ``cells``: the report's rows by kind (base cell, balance, total) and ``closings``, the exact
  closing balance of each account and weekly column;
* ``scope``: which columns of which kind a step has computed anew. A column's rows are
  those of the last step that lists it.

A step recomputes the base cells of the columns that hold a changed day; the balance
chain from the month of the first of them on, starting from the closings before it; the
totals of all these columns. Its partitions carry its number, and ``scope`` is written last: a step that
died is run again under the same number and overwrites what it left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import report as RP
from ..functions import scalars as S
from ..operators import balances as B
from ..operators import intervals as I
from ..operators import rules as RU
from ..operators.versions import put_partitions
from ..session import materialize
from ..sources.tables import local_frame, read_folder

BASE, CHAIN, TOTAL, DONE = "base", "chain", "total", "done"


def signed_sums(inserted: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """Daily key sums of ledger rows (``rules.report_sources`` rows) that came and that went."""
    sums = RU.daily_sums(inserted)
    if deleted is None:
        return sums
    gone = RU.daily_sums(deleted).withColumn("amount", (-F.col("amount")).cast(S.MONEY))
    return merged(sums.unionByName(gone))


def merged(sums: DataFrame) -> DataFrame:
    """Layers of sums as one: exact, so the order of steps doesn't matter."""
    return sums.groupBy("source", "head", "account", "variable").agg(F.sum("amount").cast(S.MONEY).alias("amount"))


def _put(df: DataFrame, path: str, part: str, step: int) -> None:
    put_partitions(df.withColumn("step", F.lit(step)), f"{path.rstrip('/')}/{part}", "step")


def last_step(spark: SparkSession, path: str) -> int | None:
    """The number of the last step that is complete, None before the first. One row."""
    scope = read_folder(spark, f"{path.rstrip('/')}/scope")
    return None if scope is None else scope.agg(F.max("step")).first()[0]


def _layers(spark: SparkSession, path: str, part: str, step: int) -> DataFrame:
    """Rows of a part up to a step."""
    return read_folder(spark, f"{path.rstrip('/')}/{part}").where(F.col("step") <= step)


def _valid(spark: SparkSession, path: str, part: str, step: int, kind: str | None = None) -> DataFrame:
    """Each column's rows of the last step that computed it."""
    scope = _layers(spark, path, "scope", step)
    scope = scope.where(F.col("kind") == kind) if kind else scope
    newest = scope.groupBy("kind", "report_col").agg(F.max("step").alias("step"))
    rows = _layers(spark, path, part, step)
    rows = rows.where(F.col("kind") == kind) if kind and "kind" in rows.columns else rows
    on = ["report_col", "step"] + (["kind"] if "kind" in rows.columns else [])
    return rows.join(newest, on, "left_semi")


def report(spark: SparkSession, path: str) -> DataFrame:
    """The report as of the last step."""
    return _valid(spark, path, "cells", last_step(spark, path)).select(*RU.CELL_COLUMNS)


def build(inp: RP.ReportInputs, path: str) -> DataFrame:
    """Step 0: the state from all ledgers."""
    if last_step(inp.terms.sparkSession, path) is None:
        _put(RU.daily_sums(inp.sources()), path, "sums", 0)
        _compute(inp, path, 0, None)
    return report(inp.terms.sparkSession, path)


def apply(inp: RP.ReportInputs, path: str, delta: DataFrame, step: int | None = None) -> DataFrame:
    """The next step: ``delta`` (``signed_sums``) goes into the state. Of ``inp`` only the configuration
    is read. ``step``: its number, for a run again; a step that is complete changes nothing."""
    spark = inp.terms.sparkSession
    done = last_step(spark, path)
    step = done + 1 if step is None else step
    if step > done:
        _put(delta, path, "sums", step)
        _compute(inp, path, step, _layers(spark, path, "sums", step).where(F.col("step") == step))
    return report(spark, path)


def _compute(inp: RP.ReportInputs, path: str, step: int, delta: DataFrame | None) -> None:
    spark, columns = inp.terms.sparkSession, materialize(inp.columns)
    # the steps' layers as they are: the cells' sums add them up, block of days by block of days, so no task
    # holds every key and day of its share only to have each once
    sums = _layers(spark, path, "sums", step)
    if delta is None:
        changed = later = columns
        initial = None
    else:
        days = delta.where("amount <> 0").select("variable").distinct()
        names = I.day_join(days, "variable", columns.select("name", "date1", "date2"), "date1", "date2").select("name").distinct()
        changed = materialize(columns.join(names, "name", "left_semi"))
        # from the first changed week on, or the beginning of a month column that holds it
        first = changed.where("not ismonth").agg(F.min("date1")).first()[0]
        whole = columns.where("ismonth").where(F.lit(first).between(F.col("date1"), F.col("date2"))).agg(F.min("date1")).first()[0]
        first = min(x for x in (first, whole) if x is not None) if first else None
        later = columns.where(F.col("date1") >= first) if first else columns.limit(0)
        closings = _valid(spark, path, "closings", step - 1, CHAIN).where(F.col("date1") < first) if first else None
        initial = closings.groupBy("account", "col_status").agg(
            F.max_by("closing", F.struct("date1", "col_index")).alias("opening")) if first else None
    fresh = RU.cells_of(sums, inp.rules, inp.lines, changed, inp.usd_rate)
    base = fresh
    if delta is not None:
        old = _valid(spark, path, "cells", step - 1, BASE).select(*RU.CELL_COLUMNS)
        base = old.join(changed.select(F.col("name").alias("report_col")), "report_col", "left_anti").unionByName(fresh)
    base = materialize(base)
    chain = materialize(B.chain(base.join(later.select(F.col("name").alias("report_col")), "report_col", "left_semi"), later, initial))
    balances = materialize(B.chain_cells(chain, inp.lines, later))
    redone = changed.unionByName(later).distinct()
    names = redone.select(F.col("name").alias("report_col"))
    over = balances
    if delta is not None:  # columns that changed before the chain's suffix keep their balances
        kept = _valid(spark, path, "cells", step - 1, CHAIN).select(*RU.CELL_COLUMNS)
        over = kept.join(later.select(F.col("name").alias("report_col")), "report_col", "left_anti").unionByName(balances)
    below = materialize(base.unionByName(over).join(names, "report_col", "left_semi").select(*RU.CELL_COLUMNS))
    totals = RP.totals_over_chain(inp, below, redone)
    own = base.join(changed.select(F.col("name").alias("report_col")), "report_col", "left_semi").select(*RU.CELL_COLUMNS)
    kinds = [(BASE, own, changed), (CHAIN, balances, later), (TOTAL, totals, redone)]
    _put(_all(df.select(*RU.CELL_COLUMNS).withColumn("kind", F.lit(k)) for k, df, _ in kinds), path, "cells", step)
    _put(chain.select("account", "col_status", "report_col", "col_index", "date1", "closing"), path, "closings", step)
    done = local_frame(spark, [(DONE, None)], "kind string, report_col string")     # a step that changes no column is done, too
    _put(_all([done, *(c.select(F.lit(k).alias("kind"), F.col("name").alias("report_col")) for k, _, c in kinds)]), path, "scope", step)


def _all(frames) -> DataFrame:
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    return out
