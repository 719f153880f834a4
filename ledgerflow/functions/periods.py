"""Calendar expressions.

"Week" here is the week of the month: buckets end on day 7, 14, 21, 28 and
on the last day of the month (the last bucket has 0-3 days).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed
from .scalars import col


# P12 ---------------------------------------------------------------------------
def to_day(c, dtype: T.DataType | None = None) -> Column:
    """Text, timestamp or date -> DATE; unparsable text gives NULL."""
    if dtype is None or isinstance(dtype, T.StringType):
        return F.try_to_date(F.substring(col(c).cast("string"), 1, 10))
    return col(c).cast("date")


# P13 ---------------------------------------------------------------------------
def week_end(d) -> Column:
    """End of the week-of-month bucket holding ``d`` (NULL stays NULL)."""
    d = col(d).cast("date")
    day = F.dayofmonth(d)
    return (F.when(day <= 28, F.make_date(F.year(d), F.month(d), (F.ceil(day / 7) * 7).cast("int")))
            .otherwise(F.last_day(d)))


# P14, P15 ----------------------------------------------------------------------
def shift_days(d, days) -> Column:
    n = F.lit(days) if isinstance(days, int) else col(days)
    return F.date_add(col(d).cast("date"), n.cast("int"))


# P24 ---------------------------------------------------------------------------
def weekday_number(name) -> Column:
    """Weekday name -> 0 (Monday) .. 6 (Sunday); unknown names give NULL."""
    m = F.create_map(*[x for i, n in enumerate(fixed.WEEKDAYS) for x in (F.lit(n), F.lit(i))])
    return m[col(name)]


# P25 ---------------------------------------------------------------------------
def week_number(d, weekday) -> Column:
    """How many ``weekday``s (0=Monday) fall between 1 January and ``d``,
    both included."""
    d = col(d).cast("date")
    k = F.lit(weekday) if isinstance(weekday, int) else col(weekday)
    first = F.pmod(k - F.weekday(F.trunc(d, "year")), F.lit(7))      # offset of 1st one
    return (F.floor((F.dayofyear(d) - 1 - first) / 7) + 1).cast("int")


# P26 ---------------------------------------------------------------------------
def weekday_dates(year, weekday) -> Column:
    """Array of all dates of ``weekday`` (0=Monday) in ``year``; explode it."""
    y = F.lit(year) if isinstance(year, int) else col(year)
    k = F.lit(weekday) if isinstance(weekday, int) else col(weekday)
    jan1 = F.make_date(y, F.lit(1), F.lit(1))
    first = F.date_add(jan1, F.pmod(k - F.weekday(jan1), F.lit(7)).cast("int"))
    return F.sequence(first, F.make_date(y, F.lit(12), F.lit(31)), F.expr("INTERVAL 7 DAYS"))


# P27 ---------------------------------------------------------------------------
def is_valid_date(y, m, d) -> Column:
    """True when (y, m, d) is a calendar date."""
    text = F.format_string("%04d-%02d-%02d", col(y).cast("int"), col(m).cast("int"),
                           col(d).cast("int"))
    ok = F.try_to_date(text, "yyyy-MM-dd").isNotNull()
    return F.coalesce(ok & (col(m) >= 1) & (col(d) >= 1), F.lit(False))
