"""Whole-table scans (S1) and the small configuration frames.

Scans are lazy ``spark.read.parquet`` calls: Catalyst prunes columns and pushes
filters into the Parquet reader, so callers select only what they use.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations"]


def _sql_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, dt.date):
        return f"DATE '{v.isoformat()}'"
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def local_frame(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """A small in-driver table as an inline ``VALUES`` relation. Unlike a
    frame made from a Python list, a local relation carries its true size,
    so the planner broadcasts it and folds constants through it."""
    st = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    if not rows:
        return spark.createDataFrame([], st)
    names = [f.name for f in st.fields]
    body = ", ".join("(" + ", ".join(_sql_literal(v) for v in r) + ")" for r in rows)
    cols = ", ".join(f"CAST(`{f.name}` AS {f.dataType.simpleString()}) AS `{f.name}`"
                     for f in st.fields)
    return spark.sql(f"SELECT {cols} FROM VALUES {body} AS t({', '.join(f'`{n}`' for n in names)})")


class Folder(str):
    """A data folder for one call of a query: each of its tables is listed and its schema
    read once, however many views are made of it. The next call lists anew."""

    def relation(self, spark: SparkSession, name: str) -> DataFrame:
        held = self.__dict__.setdefault("held", {})
        if name not in held:
            held[name] = spark.read.parquet(f"{self.rstrip('/')}/{name}.parquet")
        return held[name]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the data folder, listed anew on every call (of a query, for
    a ``Folder``), so rows appended since the last one are there."""
    if isinstance(sf_dir, Folder):
        return sf_dir.relation(spark, name)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --- configuration frames (bounded by construction: a few hundred rows) ------

LINES_SCHEMA = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("report_name", T.StringType(), False),
    T.StructField("group_no", T.StringType(), True),
    T.StructField("line_name", T.StringType(), False),
    T.StructField("unit", T.StringType(), True),
    T.StructField("line_number", T.IntegerType(), False),
])

COLUMNS_SCHEMA = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("col_no", T.IntegerType(), False),
    T.StructField("month", T.StringType(), True),
    T.StructField("date1", T.DateType(), False),
    T.StructField("date2", T.DateType(), False),
    T.StructField("ismonth", T.BooleanType(), False),
    T.StructField("col_status", T.StringType(), False),
])

SETTINGS_SCHEMA = T.StructType([
    T.StructField("usd_rate", T.DoubleType(), False),
    T.StructField("cf_date", T.DateType(), False),
    T.StructField("yearly_shipment_qty_akl", T.DoubleType(), False),
])


def report_line_rows() -> list[tuple]:
    """Report-line config rows: id series CFRL####, ladder order."""
    return [(fixed.LINE_ID_FORMAT % n, report, group, line, unit, n)
            for n, report, group, line, unit in fixed.REPORT_LINES]


def report_lines(spark: SparkSession) -> DataFrame:
    return local_frame(spark, report_line_rows(), LINES_SCHEMA)


#: Whole-month columns are numbered from here, so weekly numbers may grow with the years.
MONTH_COLUMNS_FROM = 50_000


def report_columns_between(years: DataFrame) -> DataFrame:
    """Report columns of all years from ``first`` to ``last`` (one row). Per month
    five week-of-month ranges (1-7, 8-14, 15-21, 22-28, 29-end; a February of 28
    days has four) for Projected (odd col_no) and Actual (even col_no), numbered
    through, so ``col_no - 2`` is the previous week of the same status; plus one
    whole-month column per month and status, from ``MONTH_COLUMNS_FROM`` on."""
    months = years.select(F.explode(F.sequence("first", "last")).alias("year")).select(
        "year", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("m"))
    start = F.make_date("year", "m", F.lit(1))
    months = months.select(start.alias("start"), F.element_at(literal_array(fixed.MONTHS), F.col("m")).alias("month"))
    weeks = months.select("month", F.explode(F.array(*[F.date_add("start", 7 * w) for w in range(5)])).alias("date1"), "start")
    weeks = weeks.where(F.trunc("date1", "month") == F.col("start")).select(
        "month", "date1", F.least(F.date_add("date1", 6), F.last_day("date1")).alias("date2"), F.lit(False).alias("ismonth"))
    whole = months.select("month", F.col("start").alias("date1"), F.last_day("start").alias("date2"), F.lit(True).alias("ismonth"))
    order = Window.partitionBy("ismonth").orderBy("date1")     # a few hundred rows a decade
    rows = weeks.unionAll(whole).withColumn("k", F.row_number().over(order))
    both = F.explode(F.array(F.struct(F.lit("Projected").alias("col_status"), F.lit(1).alias("back")),
                             F.struct(F.lit("Actual").alias("col_status"), F.lit(0).alias("back")))).alias("s")
    rows = rows.select("*", both).withColumn(
        "col_no", (2 * F.col("k") - F.col("s.back") + F.when(F.col("ismonth"), MONTH_COLUMNS_FROM).otherwise(0)).cast("int"))
    return rows.select(F.format_string(fixed.COLUMN_ID_FORMAT, "col_no").alias("name"), "col_no", "month", "date1", "date2",
                       "ismonth", F.col("s.col_status").alias("col_status"))


def report_columns(spark: SparkSession, year: int, last: int | None = None) -> DataFrame:
    """Report columns of ``year`` (to ``last``)."""
    return report_columns_between(local_frame(spark, [(year, last or year)], "first int, last int"))


def optional_table(spark: SparkSession, data_dir: str, name: str) -> DataFrame | None:
    """A table of the folder, or None where it has none. Any other fault is raised."""
    return read_folder(spark, f"{data_dir.rstrip('/')}/{name}.parquet")


def read_folder(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``, or None where there is none. Any other fault is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def settings(spark: SparkSession, usd_rate: float | None = None, cf_date: str | None = None,
             target: float | None = None) -> DataFrame:
    """The one-row settings frame."""
    s = fixed.DEFAULT_SETTINGS
    row = (float(usd_rate if usd_rate is not None else s["usd_rate"]),
           dt.date.fromisoformat(cf_date or s["cf_date"]),
           float(target if target is not None else s["yearly_shipment_qty_akl"]))
    return local_frame(spark, [row], SETTINGS_SCHEMA)


def setting(spark: SparkSession, key: str, settings_df: DataFrame | None = None):
    """One setting as a scalar-subquery Column (evaluated once, no join)."""
    return (settings_df if settings_df is not None else settings(spark)).select(key).scalar()


def rules(spark: SparkSession) -> DataFrame:
    """The default rule set as a frame: one row per (status, line)."""
    scaled = set(fixed.USD_PER_THOUSAND_RULES)
    rows = [(status, line, source, dim, key if key is not None else line,
             "usd_per_thousand" if (status, line) in scaled else None)
            for status, line, source, dim, key in fixed.RULES]
    schema = "col_status string, line_name string, source string, dim string, key string, scale string"
    return local_frame(spark, rows, schema)


def literal_array(values: list[str]):
    """ARRAY literal of strings as one SQL expression (one driver round trip)."""
    return F.expr("array(" + ", ".join(_sql_literal(v) for v in values) + ")")
