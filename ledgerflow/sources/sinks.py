"""Sinks: replace (S6, S8), append (S7) and spreadsheet export.

All writes are distributed (one file per task). A table that is rebuilt from
itself (the snapshot import reads the current forecast and writes the next)
is written beside the old one and swapped in, so nothing is deleted that is
still read, and a lost executor finds its input.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame


def replace_table(df: DataFrame, path: str, fmt: str = "parquet",
                  partition_by: Sequence[str] | None = None) -> str:
    """S6 (+S8 truncate): the table at ``path`` becomes exactly ``df``. A frame
    that reads ``path`` is refused, as the overwrite would delete its input
    first; ``replace_from_itself`` takes it."""
    if reads(df, path):
        raise ValueError(f"{path} is read by the frame that replaces it; use replace_from_itself")
    w = df.write.mode("overwrite").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path


def reads(df: DataFrame, path: str) -> bool:
    """Whether any input file of ``df`` lies in ``path`` (planning only)."""
    bare = lambda p: "/" + p.split(":", 1)[-1].lstrip("/").rstrip("/")
    return any(bare(f).startswith(bare(path) + "/") for f in df.inputFiles())


def replace_from_itself(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """S6 for a frame computed from the table it replaces: the new version is
    written beside the old one, then they change places by renaming. A run
    that dies before that leaves the table as it was."""
    spark, tag = df.sparkSession, uuid.uuid4().hex
    new, old = f"{path.rstrip('/')}.{tag}.new", f"{path.rstrip('/')}.{tag}.old"
    df.write.format(fmt).save(new)
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.rename(at(path), at(old)) or not fs.rename(at(new), at(path)):
        raise OSError(f"{path} could not change places with {new}; the old table is {old}")
    fs.delete(at(old), True)
    spark.catalog.refreshByPath(path)
    return path


def append_rows(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Add rows to the table at ``path``."""
    df.write.mode("append").format(fmt).save(path)
    return path


def export_sheet(df: DataFrame, path: str, single_file: bool = False) -> str:
    """Delimited export with a header row. ``single_file`` funnels the
    rows through one task -- only for small report frames (weekly sums)."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).csv(path)
    return path
