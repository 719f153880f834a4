"""Days in date ranges as an equi join (J4): a dyadic interval index.

The axis of days is cut in aligned blocks of 1, 2, 4, ... days: block ``b`` of level
``k`` holds the days ``b * 2^k`` to ``(b + 1) * 2^k - 1`` after 1970-01-01. A range of
n days is at most ``2 * log2(n)`` blocks, at most two of a level, and a day lies in one block of
each level, so it meets exactly one block of every range that holds it. Ranges and
days join on (level, block): a range of twenty years is some 25 rows instead of 7,305, and a range
of one day is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of the longest range: 2^24 days, beyond the calendar.
LEVELS = 24


def _day_number(day: Column) -> Column:
    return F.unix_date(day.cast("date")).cast("long")


def _up(x: Column, k: Column) -> Column:
    """ceil(x / 2^k)."""
    return -F.call_function("shiftright", -x, k)


def range_blocks(first: Column, last: Column) -> Column:
    """Array of (level, block) whose days are exactly ``first`` to ``last``, both included;
    empty where last is before first, null where either is null.

    Of the whole blocks of a level inside the range, ``[lo, hi)``, those belong to it
    whose parent isn't inside: an odd first one, and one before an odd end."""
    a, b = _day_number(first), _day_number(last) + 1

    def of(k: Column) -> Column:
        lo, hi = _up(a, k), F.call_function("shiftright", b, k)
        odd = lambda x: x.bitwiseAND(F.lit(1).cast("long")) == 1
        left = F.when((lo < hi) & odd(lo), F.struct(k.alias("level"), lo.alias("block")))
        right = F.when((lo < hi) & odd(hi), F.struct(k.alias("level"), (hi - 1).alias("block")))
        return F.array(left, right)

    levels = F.sequence(F.lit(0), F.least(F.lit(LEVELS), F.ceil(F.log2(F.greatest(b - a, F.lit(1)))).cast("int")))
    return F.filter(F.flatten(F.transform(levels, of)), lambda x: x.isNotNull())


def with_day_blocks(days: DataFrame, day: str, top) -> DataFrame:
    """``days`` with a row (level, block) for each level up to ``top``: the block their ``day`` lies in."""
    rows = days.withColumn("level", F.explode(F.sequence(F.lit(0), top)))
    return rows.withColumn("block", F.call_function("shiftright", _day_number(F.col(day)), F.col("level")))


def indexed(ranges: DataFrame, first: str, last: str) -> DataFrame:
    """``ranges`` with a row (level, block) for each of their blocks; empty ranges have none."""
    return ranges.withColumn("_b", F.explode(range_blocks(F.col(first), F.col(last)))).select(
        *ranges.columns, F.col("_b.level").alias("level"), F.col("_b.block").alias("block"))


def top_level(blocks: DataFrame) -> Column:
    """The highest level that any indexed range uses, as a scalar subquery."""
    return F.coalesce(blocks.agg(F.max("level").alias("top")).select("top").scalar(), F.lit(0))


def day_join(days: DataFrame, day: str, ranges: DataFrame, first: str, last: str, on: list[str] = ()) -> DataFrame:
    """Rows of ``days`` with every row of ``ranges`` whose ``first`` to ``last`` holds their
    ``day`` (and whose ``on`` columns are equal); other column names must not clash."""
    blocks = indexed(ranges, first, last)
    points = with_day_blocks(days, day, top_level(blocks))
    return points.join(blocks, [*on, "level", "block"]).drop("level", "block")
