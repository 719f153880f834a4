"""Row-level scalar expressions.

All are built-in Column expressions, so they stay inside whole-stage codegen.
Money sums go through exact DECIMAL arithmetic (``money_sum``) so the result
does not depend on how rows are split over tasks.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed

MONEY = T.DecimalType(38, 6)      # sums: micro-units, order independent
GROSS = T.DecimalType(20, 6)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def value(x) -> Column:
    """A Python number / Column (e.g. a setting read as a scalar subquery)."""
    return x if isinstance(x, Column) else F.lit(x)


def dec(x: str) -> Column:
    """Exact decimal literal (a Python float literal would be a double)."""
    return F.lit(Decimal(x))


# P4 -------------------------------------------------------------------------
def fill_nulls(df: DataFrame, number=0, text="0") -> DataFrame:
    """Null fill on every column, as a spreadsheet import does: numbers get
    ``number``, text gets ``text`` (Spark's ``fillna(0)`` alone skips text)."""
    return df.fillna(number).fillna(text)


# P5 -------------------------------------------------------------------------
def drop_any_null(df: DataFrame) -> DataFrame:
    return df.dropna(how="any")


# P6, P7 --------------------------------------------------------------------
def strip_currency(c) -> Column:
    return F.regexp_replace(col(c).cast("string"), r"\$", "")


def to_double(c, dtype: T.DataType | None = None) -> Column:
    """Text or number -> DOUBLE; unparsable text becomes NULL (ANSI-safe).
    Text has the currency sign removed first (P6)."""
    if dtype is not None and not isinstance(dtype, T.StringType):
        return col(c).cast("double")
    return strip_currency(c).try_cast("double")


def number_of(df: DataFrame, name: str) -> Column:
    """P6+P7 for a column of ``df``, decided from its declared type."""
    return to_double(name, df.schema[name].dataType)


# P8, P9 --------------------------------------------------------------------
def net_shipment_amount(price, qty) -> Column:
    """round(p*q - p*q*0.001) half-even to whole units, in exact decimal."""
    gross = (col(price) * col(qty)).cast(GROSS)
    return F.bround(gross - gross * dec("0.001"), 0).cast("double")


def net_bill_amount(a) -> Column:
    """a - a*0.001 (no rounding)."""
    return col(a) - col(a) * F.lit(fixed.BANK_CHARGE)


# P10, P11 -------------------------------------------------------------------
def ratio_split(amount, ratio, share: bool = False) -> Column:
    """amount / ratio * 100; a zero, empty or null ratio gives NULL (the
    infinity a plain division would give is dropped). ``share=True`` reads the
    ratio as a percentage share instead: amount * ratio / 100."""
    if share:
        return col(amount) * col(ratio) / F.lit(fixed.RATIO_SCALE)
    return F.try_divide(col(amount), col(ratio)) * F.lit(fixed.RATIO_SCALE)


# P16, P17, P28 ----------------------------------------------------------------
def line_amount(qty, rate) -> Column:
    return col(qty) * col(rate)


def usd_per_thousand(x, usd_rate) -> Column:
    return col(usd_rate) * col(x) / F.lit(1000)


def half(x) -> Column:
    return col(x) * F.lit(0.5)


# P18 -------------------------------------------------------------------
def money(x) -> Column:
    return col(x).cast(MONEY)


def money_sum(x) -> Column:
    """SUM over amounts held exactly to 6 decimals, returned as DECIMAL."""
    return F.sum(money(x))


def round_cell(x, digits: int) -> Column:
    """Half-even rounding of an exact decimal, returned as DOUBLE."""
    return F.bround(col(x), digits).cast("double")


# P20 --------------------------------------------------------------------------
def trimmed(c) -> Column:
    return F.trim(col(c))


# P21 --------------------------------------------------------------------------
def first_present(*cols) -> Column:
    """First non-null, non-empty value in priority order."""
    parts = []
    for c in cols:
        cc = col(c)
        parts.append(F.when(cc.cast("string") != "", cc))
    return F.coalesce(*parts)


# P22 --------------------------------------------------------------------------
def header_key(name) -> str:
    """Sheet header as a key: stringified, first 10 characters."""
    return str(name)[:10]


# P23 --------------------------------------------------------------------------
def date_key(d) -> Column:
    return F.date_format(col(d), "yyyy-MM-dd")


# P29 --------------------------------------------------------------------------
def below_target_message(total, target, message: str = fixed.CHECK_MESSAGE) -> Column:
    return F.when(col(total) < col(target), F.lit(message)).otherwise(F.lit(""))
