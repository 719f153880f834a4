"""Tables kept as versions: imports that move the Active rows on without rewriting history
(W1), and appends that a rerun doesn't double (S7).

A table is a folder of two Parquet tables:

* ``rows``, partitioned by ``version``: each import writes its own partition, once, and no
  other file is touched;
* ``versions``, a row for each import: its number and the batch it came from.

A version counts from the moment its row is in ``versions``, which is written last, so a run
that dies before leaves the table as it was, and its rerun overwrites its own half-written
partition (dynamic partition overwrite). The last version's rows have the status they
were stored with; those of all older ones are Inactive, by their number alone. So the current
snapshot is a partition filter, however long the history.

One import at a time: two that run at once would take the same number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..sources.tables import local_frame, read_folder
from .imports import imported_rows

VERSIONS = "version long, batch string"


def _at(path: str, part: str) -> str:
    return f"{path.rstrip('/')}/{part}"


def put_partitions(df: DataFrame, path: str, by: str) -> None:
    """Write the partitions of ``df``; others stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def content_of(df: DataFrame) -> str:
    """A digest of a frame's rows in any order: their number and the sum of their hashes, exact."""
    names = [f"`{c}`" for c in df.columns]
    wide = [F.sum(F.xxhash64(*names, F.lit(k)).cast("decimal(38,0)")) for k in (1, 2)]
    return df.agg(F.sha2(F.concat_ws(":", F.count(F.lit(1)), *wide), 256)).first()[0]


def create(table: DataFrame, path: str) -> str:
    """A versioned table at ``path`` whose version 0 is ``table``. A table that is there stays."""
    spark = table.sparkSession
    if last_version(spark, path) is None:
        put_partitions(table.withColumn("version", F.lit(0).cast("long")), _at(path, "rows"), "version")
        put_partitions(local_frame(spark, [(0, "created")], VERSIONS), _at(path, "versions"), "version")
    return path


def last_version(spark: SparkSession, path: str):
    """(version, batch) of the last import, None where there is no table. One row."""
    listed = read_folder(spark, _at(path, "versions"))
    return None if listed is None else listed.select(F.max_by(F.struct("version", "batch"), "version").alias("v")).first()["v"]


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all versions that count."""
    rows = spark.read.parquet(_at(path, "rows"))
    return rows.withColumn("version", F.col("version").cast("long")).where(F.col("version") <= last_version(spark, path)["version"])


def history(spark: SparkSession, path: str, status_col: str = "status") -> DataFrame:
    """The whole table, as after the last import: older versions' rows are Inactive."""
    last = last_version(spark, path)["version"]
    return _rows(spark, path).withColumn(status_col, F.when(F.col("version") == last, F.col(status_col)).otherwise(F.lit("Inactive")))


def current(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the last version: one partition."""
    return _rows(spark, path).where(F.col("version") == last_version(spark, path)["version"])


def import_upload(upload: DataFrame, path: str, mapping: Sequence[tuple[str, str]] = fixed.FORECAST_UPLOAD_FIELDS,
                  status_col: str = "status", date_fields: Sequence[str] = ("exfty_date",), batch: str | None = None) -> int:
    """The upload's rows as the next version, all Active; returns its number. ``batch``
    names the upload (a file's name and size, say), else its content does; the upload that is
    the last version already changes nothing."""
    spark = upload.sparkSession
    last = last_version(spark, path)
    batch = content_of(upload) if batch is None else batch
    if last["batch"] == batch:
        return last["version"]
    schema = spark.read.parquet(_at(path, "rows")).drop("version").schema
    number = last["version"] + 1
    new = imported_rows(schema, upload, mapping, status_col, date_fields)
    put_partitions(new.withColumn("version", F.lit(number).cast("long")), _at(path, "rows"), "version")
    put_partitions(local_frame(spark, [(number, batch)], VERSIONS), _at(path, "versions"), "version")
    return number


def append_batch(rows: DataFrame, path: str, batch: str) -> str:
    """S7 that may be run again: the rows of a batch are a partition of their own, and
    appending the batch once more replaces them by the same. ``batch`` is a name (of a run, a
    report column, a file)."""
    put_partitions(rows.withColumn("batch", F.lit(batch)), path, "batch")
    return path
