"""Lines of delimited files with their numbers, and the records they make.

Spark reads a file in splits and its rows have no order of their own. A split is read by one
task from its first line to its last, so a line's number is the lines of the file's
earlier splits, one number each, and its place in its own. The same sums carry whether a
quoted field is open, so a record whose field holds line breaks is put together
again, also across splits. No file goes through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPLIT = ["file", "split"]


def _read(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path)
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                       F.monotonically_increasing_id().alias("_at"))


def _before(per_split: DataFrame, column: str, out: str) -> Column:
    """What the file's earlier splits add up to: a row for each split."""
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(earlier), F.lit(0)).alias(out)


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): every line of the files at ``path``, numbered from 0 in its file."""
    rows = _read(spark, path)
    splits = rows.groupBy(*SPLIT).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    splits = splits.select(*SPLIT, (_before(splits, "_n", "_b") - F.col("_first")).alias("_shift"))
    return rows.join(splits, SPLIT).select("file", (F.col("_at") + F.col("_shift")).alias("line_no"), "value")


def records(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """(file, row_no, record): the records, numbered from 0 in their file. A record goes on as long as
    a quoted field is open, line breaks and all. Records are put in order within
    their split; a field that never closes makes one record of the rest of the file."""
    rows = _read(spark, path).withColumn("_quotes", F.char_length("value") - F.char_length(F.replace("value", F.lit(quote), F.lit(""))))
    splits = rows.groupBy(*SPLIT).agg(F.sum("_quotes").alias("_q"))
    opened = splits.select(*SPLIT, _before(splits, "_q", "_open"))
    order = Window.partitionBy(*SPLIT).orderBy("_at")
    rows = rows.join(opened, SPLIT)
    ahead = F.col("_open") + F.coalesce(F.sum("_quotes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_starts", (F.pmod(ahead, F.lit(2)) == 0).cast("long"))
    starts = rows.groupBy(*SPLIT).agg(F.sum("_starts").alias("_n"))
    earlier = starts.select(*SPLIT, _before(starts, "_n", "_earlier"))
    number = F.col("_earlier") + F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    rows = rows.join(earlier, SPLIT).select("file", "split", "_at", "value", number.alias("row_no"))
    lines = F.array_sort(F.collect_list(F.struct("split", "_at", "value")))
    return rows.groupBy("file", "row_no").agg(F.array_join(F.transform(lines, lambda x: x["value"]), "\n").alias("record"))


def fields(record: Column, n: int, separator: str = ",") -> Column:
    """A record's first ``n`` fields as a struct of texts c0, c1, ...; missing ones null."""
    schema = ", ".join(f"c{k} string" for k in range(n))
    return F.from_csv(record, schema, {"sep": separator, "multiLine": "true", "mode": "PERMISSIVE"})
