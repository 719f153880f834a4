"""Spreadsheet-shaped inputs: uploads (S5) and wide planning sheets.

Binary workbooks are decoded outside Spark; Spark reads their delimited or
Parquet exports. Uploads keep their own header names (mapped to fields by
``operators.imports.map_upload``). Spark rows have no order of their own: a wide sheet
export carries an explicit ``row_no`` column, or gets one from the place of its records
in the file (``read_raw_sheet``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lines
from ..functions import periods as P
from ..functions.scalars import to_double


def read_upload(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                fmt: str = "csv") -> DataFrame:
    """An uploaded file, header row first. Pass the schema in production:
    inferring it costs a full extra pass over the file."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("mode", "PERMISSIVE")
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt == "csv":
        reader = reader.option("inferSchema", True)
    return reader.load(path)


def read_sheet(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               fmt: str = "csv") -> DataFrame:
    """A wide sheet export (row_no, label, unit, one column per date,
    quarter subtotals). Column names are kept exactly as written."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt == "csv":
        reader = reader.option("inferSchema", True)
    return reader.load(path)


def read_raw_sheet(spark: SparkSession, path: str, n_columns: int) -> DataFrame:
    """A delimited sheet as it is, without headers or numbers: ``row_no`` from 0 by the place in
    the file, and ``n_columns`` text columns c0, c1, ... Fields may hold line breaks."""
    rows = lines.records(spark, path)
    cells = rows.select(F.col("row_no").cast("int").alias("row_no"), lines.fields(F.col("record"), n_columns).alias("f"))
    return cells.select("row_no", "f.*")


def read_upload_checked(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """S5 with quarantine: (good, rejected) of a delimited upload whose files begin with the header
    ``schema`` names. Every line below a header is in one of them: a good one in ``schema``'s types, a
    rejected one as (file, line, problems, text), ``line`` counted from 1 and ``problems`` an array of
    (field, reason, value). Reasons: a number of fields that isn't the header's, a quote that
    isn't closed, text where a number or a date belongs. Empty fields are null."""
    rows = lines.numbered(spark, path).where("line_no > 0")
    texts = ", ".join(f"f{k} string" for k in range(len(schema.fields)))
    parsed = F.from_csv("value", f"{texts}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    quotes = F.char_length("value") - F.char_length(F.replace("value", F.lit('"'), F.lit("")))
    rows = rows.withColumns({"p": parsed, "open": F.pmod(quotes, F.lit(2)) == 1})
    values, problems = [], []
    problem = lambda when, field, reason, value: F.when(when, F.struct(F.lit(field).alias("field"), F.lit(reason).alias("reason"), value.alias("value")))
    whole = F.lit(None).cast("string")
    problems.append(problem(F.col("open"), whole, "quote not closed", whole))
    problems.append(problem(~F.col("open") & F.col("p._bad").isNotNull(), whole, "number of fields", whole))
    sound = ~F.col("open") & F.col("p._bad").isNull()
    for k, f in enumerate(schema.fields):
        text = F.when(F.trim(f"p.f{k}") != "", F.col(f"p.f{k}"))
        if isinstance(f.dataType, T.NumericType):
            value, reason = to_double(text, T.StringType()), "not a number"
        elif isinstance(f.dataType, T.DateType):
            value, reason = P.to_day(text, T.StringType()), "not a date"
        else:
            value, reason = text, None
        values.append(value.cast(f.dataType).alias(f.name))
        if reason:
            problems.append(problem(sound & text.isNotNull() & value.isNull(), f.name, reason, text))
    split = rows.select("file", (F.col("line_no") + 1).alias("line"), F.filter(F.array(*problems), lambda x: x.isNotNull()).alias("problems"),
                        F.struct(*values).alias("row"), F.col("value").alias("text"))
    return split.where(F.size("problems") == 0).select("row.*"), split.where(F.size("problems") > 0).select("file", "line", "problems", "text")
