"""Wide <-> long reshaping (R1-R3), sheet regions (S4, F10, P22) and Q14.

A planning sheet is wide: a label, a unit and one column per date. Spark rows
carry no order of their own, so a sheet export carries an explicit ``row_no``
and a region is a ``row_no`` range, not a positional slice.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.periods import to_day
from ..functions.scalars import header_key, to_double

QUARTER_COLUMNS = ("Apr", "May", "Jun")


def sheet_region(df: DataFrame, first_row: int, last_row: int,
                 drop: Iterable[str] = QUARTER_COLUMNS, row_col: str = "row_no",
                 from_column: int = 0) -> DataFrame:
    """S4 + F10: rows ``first_row..last_row`` (inclusive, by ``row_col``),
    without the subtotal columns in ``drop``, without ``row_col``, and
    without the first ``from_column`` sheet columns (leading serial-number or
    account columns, counted after ``row_col``)."""
    sheet_cols = [c for c in df.columns if c != row_col][from_column:]
    keep = [c for c in sheet_cols if c not in set(drop)]
    return (df.where(F.col(row_col).between(first_row, last_row))
            .select(*[F.col(f"`{c}`") for c in keep]))


def normalise_headers(df: DataFrame) -> DataFrame:
    """Every header becomes its first 10 characters. Two headers that
    collapse to the same key are an error rather than a silent overwrite."""
    keys = [header_key(c) for c in df.columns]
    dup = sorted({k for k in keys if keys.count(k) > 1})
    if dup:
        raise ValueError(f"headers collide after trimming to 10 characters: {dup}")
    return df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(df.columns, keys)])


def wide_to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str] | None = None,
                 variable: str = "variable", value: str = "value") -> DataFrame:
    """One output row per (input row, value column); null cells are kept."""
    values = [c for c in df.columns if c not in ids] if values is None else list(values)
    cols = [F.col(f"`{c}`").cast("double").alias(c) for c in values]
    return (df.select(*[F.col(f"`{i}`") for i in ids], *cols)
            .unpivot(list(ids), values, variable, value))


def region_to_long(sheet: DataFrame, first_row: int | None = None, last_row: int | None = None,
                   drop: Iterable[str] = (), ids: Sequence[str] = ("Description", "Unit"), cells: str = "cells",
                   row_col: str = "row_no") -> DataFrame:
    """S4, P22 and R1 of a schema-free sheet: rows ``first_row..last_row`` whose value columns are a map
    from header to number, melted under 10-character headers, null cells kept, headers in
    ``drop`` left out. The plan is the same for a month and for thirty years of columns. Two
    headers of a row that collapse to one key are an error."""
    rows = sheet if first_row is None else sheet.where(F.col(row_col).between(first_row, last_row))
    dropped = F.array(*map(F.lit, drop)) if drop else F.array().cast("array<string>")
    kept = F.map_filter(cells, lambda k, _: ~F.array_contains(dropped, k))
    keys = F.transform(F.map_keys("_cells"), lambda k: F.substring(k, 1, 10))
    rows = rows.select(*[F.col(f"`{i}`").alias(header_key(i)) for i in ids], kept.alias("_cells"))
    clash = F.size(F.array_distinct(keys)) < F.size(keys)
    entries = F.when(clash, F.raise_error(F.lit("headers collide after trimming to 10 characters"))).otherwise(F.map_entries("_cells"))
    names = [header_key(i) for i in ids]
    return rows.select(*names, F.explode(entries).alias("e")).select(
        *names, F.substring("e.key", 1, 10).alias("variable"), F.col("e.value").cast("double").alias("value"))


def load_sheet_region(df: DataFrame, first_row: int, last_row: int,
                      drop: Iterable[str] = QUARTER_COLUMNS,
                      ids: Sequence[str] = ("Descriptio", "Unit"),
                      from_column: int = 0) -> DataFrame:
    """Q14: region -> 10-character headers -> long fact
    ``(Descriptio, Unit, variable DATE, value)``."""
    region = normalise_headers(sheet_region(df, first_row, last_row, drop,
                                            from_column=from_column))
    long = wide_to_long(region, list(ids))
    return long.withColumn("variable", to_day("variable"))


def long_to_wide(df: DataFrame, index: str, columns: str, values: str,
                 names: Sequence[str], suffix: str = "") -> DataFrame:
    """One row per ``index``, one column per name in ``names``. A repeated
    (index, column) pair is an error, as in a strict pivot; the check runs
    inside the same aggregation, no extra job."""
    wide = (df.groupBy(index).pivot(columns, list(names))
            .agg(F.first(values).alias("v"), F.count(F.lit(1)).alias("n")))
    out = [F.col(index)]
    for name in names:
        v, n = F.col(f"`{name}_v`"), F.col(f"`{name}_n`")
        out.append(F.when(n > 1, F.raise_error(F.lit(f"duplicate pivot key for column {name}")))
                   .otherwise(v).alias(f"{name}{suffix}"))
    return wide.select(*out)


# --- regions of a raw sheet export ---------------------------------------------------
def region_of(name: str) -> tuple:
    return next(r for r in fixed.SHEET_REGIONS if r[0] == name)


def load_region(raw: DataFrame, header: Sequence[str], region: tuple, row_col: str = "row_no") -> DataFrame:
    """Q14 for one of ``fixed.SHEET_REGIONS``. ``raw`` is the sheet as exported: ``row_no``
    (from 0) and one text column per sheet column; ``header`` is the text of its
    header row (``header_of``). Blank headers are named by their place, the known
    ones renamed, quarter subtotals dropped, leading columns left out, and the
    value columns -- from the region's first on -- melted under 10-character
    headers: ``(Descriptio, Unit, variable, value)``. Text that is no number is NULL."""
    _, _, at, first, last, no_quarters, from_column, first_value = region
    sheet = [c for c in raw.columns if c != row_col]
    names = [h if h else f"Unnamed: {k}" for k, h in enumerate(header)]
    names = [fixed.SHEET_HEADER_NAMES.get(n, n) for n in names]
    kept = [(c, header_key(n)) for c, n in zip(sheet, names) if not (no_quarters and n in QUARTER_COLUMNS)][from_column:]
    rows = raw.where(F.col(row_col).between(at + 1 + first, at + last))
    ids = [next(c for c, n in kept if n == i) for i in ("Descriptio", "Unit")]
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("variable"), to_double(c, raw.schema[c].dataType).alias("value"))
                                for c, n in kept[first_value:]])).alias("cell")
    return rows.select(F.col(f"`{ids[0]}`").alias("Descriptio"), F.col(f"`{ids[1]}`").alias("Unit"), cells).select(
        "Descriptio", "Unit", "cell.variable", "cell.value")


def header_of(raw: DataFrame, region: tuple, row_col: str = "row_no") -> list[str]:
    """Text of the region's header row: one row, read as a schema is."""
    row = raw.where(F.col(row_col) == region[2]).drop(row_col).first()
    return [v or "" for v in row] if row else []
