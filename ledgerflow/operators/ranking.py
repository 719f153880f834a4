"""Places of rows in a total order, without a window over the whole table (K6).

Spark deals the rows to ranges of the order's keys, cut at quantiles of a sample that
grows with the number of ranges, so ranges follow the rows and not the keys: rows that tie
in all keys are told apart by a hash of the whole row, and equal rows by chance, so a day with
a third of all rows is a third of the ranges. Each range is sorted by its task, which may
spill. A row's place is the rows of the ranges before its own, one number each, and its
number within the range.

The dealt rows are written to the shared folder once: counts and rows then agree, whatever
task is lost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def in_ranges(df: DataFrame, order_by: Sequence[str], ranges: int | None = None) -> DataFrame:
    """``df`` written in ranges of the order, with ``_range`` and ``_at``, the row's number in
    its range (from 0). Without ``ranges`` there are as many as the session shuffles to."""
    keys = [F.col(f"`{c}`").asc_nulls_first() for c in order_by]
    plain = [f"`{f.name}`" for f in df.schema.fields if f.dataType.simpleString() not in ("variant",) and "map<" not in f.dataType.simpleString()]
    ties = [F.xxhash64(*plain).alias("_tie").asc(), F.col("_chance").asc()]
    rows = df.withColumn("_chance", F.rand(17))
    dealt = rows.repartitionByRange(ranges, *keys, *ties) if ranges else rows.repartitionByRange(*keys, *ties)
    at = F.monotonically_increasing_id()     # the task's number above, the row's number in the task below 2^33
    dealt = dealt.sortWithinPartitions(*keys, *ties).drop("_chance").withColumn("_id", at)
    return written(dealt, "ranges").withColumns({"_range": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id")


def with_place(df: DataFrame, order_by: Sequence[str], place: str = "place", ranges: int | None = None) -> DataFrame:
    """``df`` with each row's place (long, from 0) in ``order_by`` order, null keys first; ties
    in the order of a hash of the row."""
    rows = in_ranges(df, order_by, ranges)
    counts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)   # a row for each range
    shifts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(shifts, "_range").withColumn(place, F.col("_before") + F.col("_at")).drop("_range", "_at", "_before")
