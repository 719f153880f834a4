"""Table contracts as batch checks (K1-K6).

Each check returns a violations frame ``(table, check, field, value, rows)``:
one row per distinct offending value with its row count, so the output is
bounded by the number of distinct bad values, never by the table size, and
the work is a partial aggregate per task. Option lists and parent keys are
joined with a left-anti join: the option list is config sized (broadcast);
a parent table is left to Spark's size-checked join selection.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import local_frame
from .ranking import with_place

VIOLATION_SCHEMA = "table string, check string, field string, value string, rows bigint"


def _label(counts: DataFrame, table: str, check: str, field: str) -> DataFrame:
    return counts.select(F.lit(table).alias("table"), F.lit(check).alias("check"),
                         F.lit(field).alias("field"), F.col(field).cast("string").alias("value"),
                         "rows")


def _value_counts(df: DataFrame, field: str) -> DataFrame:
    """Rows per distinct non-null value: a partial aggregate in every task, so
    a value holding a third of the table is one row before any shuffle."""
    return (df.where(F.col(field).isNotNull()).groupBy(field)
            .agg(F.count(F.lit(1)).alias("rows")))


def required(df: DataFrame, table: str, fields: Iterable[str]) -> DataFrame:
    """K1: rows with a NULL (or empty text) in a required field. All fields of
    the table are checked in one scan."""
    checks = []
    for f in fields:
        c = F.col(f)
        empty = c.isNull()
        if isinstance(df.schema[f].dataType, T.StringType):
            empty = empty | (F.trim(c) == "")
        checks.append(F.when(empty, F.struct(F.lit(f).alias("field"),
                                             c.cast("string").alias("value"))))
    bad = (df.select(F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("v"))
           .select("v.field", "v.value"))
    counts = bad.groupBy("field", "value").agg(F.count(F.lit(1)).alias("rows"))
    return counts.select(F.lit(table).alias("table"), F.lit("required").alias("check"),
                         "field", "value", "rows")


def allowed_values(df: DataFrame, table: str, options: Mapping[str, Sequence[str]]) -> DataFrame:
    """K2: values outside a field's closed option list (NULL is not checked).
    All fields of the table are checked in one scan: each row yields its
    (field, value) pairs, counted per distinct pair map-side, then anti-joined
    with the option lists (config sized, broadcast)."""
    spark = df.sparkSession
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"))
                      for f in options])
    vals = (df.select(F.explode(pairs).alias("p")).select("p.field", "p.value")
            .where(F.col("value").isNotNull()))
    counts = vals.groupBy("field", "value").agg(F.count(F.lit(1)).alias("rows"))
    opts = local_frame(spark, [(f, v) for f, values in options.items()
                               for v in dict.fromkeys(values)], "field string, value string")
    bad = counts.join(F.broadcast(opts), ["field", "value"], "left_anti")
    return bad.select(F.lit(table).alias("table"), F.lit("option").alias("check"),
                      "field", "value", "rows")


def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """K3: fill declared defaults on load."""
    return df.withColumns({f: F.coalesce(F.col(f), F.lit(v).cast(df.schema[f].dataType))
                           for f, v in defaults.items()})


def unique(df: DataFrame, table: str, field: str) -> DataFrame:
    """K4: values of a unique field that occur more than once."""
    return _label(_value_counts(df, field).where(F.col("rows") > 1), table, "unique", field)


def foreign_key(df: DataFrame, table: str, field: str, parent: DataFrame,
                parent_field: str) -> DataFrame:
    """K5: values of ``field`` with no row in ``parent`` (NULL is not checked)."""
    keys = parent.select(F.col(parent_field).alias(field))
    bad = _value_counts(df, field).join(keys, field, "left_anti")
    return _label(bad, table, "foreign_key", field)


def id_series(df: DataFrame, order_by: Sequence[str], fmt: str, id_col: str = "name",
              start: int = 1) -> DataFrame:
    """K6: a gap-free formatted id series (``fmt % n``, n from ``start``) in
    ``order_by`` order, null keys first, without a window over the whole table: each row's
    place follows from ranges of the order (``ranking``). Rows that tie in all of
    ``order_by`` are numbered in the order of a hash of the row. The ranges are
    written when this is called."""
    placed = with_place(df, order_by, "_place")
    return placed.withColumn(id_col, F.format_string(fmt, F.col("_place") + F.lit(start))).drop("_place")
