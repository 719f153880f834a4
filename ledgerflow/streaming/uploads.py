"""Structured Streaming drivers for the upload flow and the weekly split.

The workbook imports a file when a user uploads it: gate (Q12), then
snapshot import (W1). ``import_stream`` runs the same two operators for every
file that lands in an upload folder: each micro-batch is gated and, when it
passes (or ``force``), the table is rebuilt as old rows Inactive + batch
Active and written to the next version folder. Progress lives in the stream's
checkpoint location, so a restarted or failed job resumes with the next file
and a replayed batch rewrites the same version folder (idempotent).

``weekly_receipts_stream`` is the weekly five-account split (A1) over a stream
of forecast rows: a streaming aggregation per week, state bounded by the
number of weeks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .. import fixed
from ..operators import forecast as FC
from ..operators import imports as IM


def version_path(base: str, batch_id: int) -> str:
    return f"{base.rstrip('/')}/version={batch_id:08d}"


def latest_version_before(spark: SparkSession, base: str, batch_id: int,
                          fallback: str) -> str:
    """Path of the newest version written by an earlier batch (file listing
    only, no data read), else ``fallback``. A replayed batch therefore
    rebuilds from the same input and rewrites the same version."""
    try:
        files = spark.read.parquet(base).inputFiles()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise                              # a storage fault is not an empty history
        return fallback
    found = {int(m.group(1)) for f in files for m in [re.search(r"version=(\d+)", f)] if m}
    earlier = [v for v in found if v < batch_id]
    return version_path(base, max(earlier)) if earlier else fallback


def import_stream(spark: SparkSession, upload_dir: str, upload_schema: T.StructType | str,
                  table_base: str, initial_table: str, checkpoint_location: str,
                  mapping: Sequence[tuple[str, str]] = fixed.FORECAST_UPLOAD_FIELDS,
                  qty_header: str = fixed.FORECAST_QTY_HEADER,
                  target: float = fixed.YEARLY_SHIPMENT_TARGET, force: bool = False,
                  on_gate: Callable[[int, dict], None] | None = None):
    """Start the import stream; returns the ``StreamingQuery``.

    ``initial_table``: path of the table before the first upload. Versions are
    written under ``table_base``; each batch reads the latest one."""
    uploads = (spark.readStream.schema(upload_schema).option("header", True)
               .option("maxFilesPerTrigger", 1).csv(upload_dir))
    def per_batch(batch: DataFrame, batch_id: int) -> None:
        gate = IM.import_gate(batch, qty_header, target).first().asDict()   # one row
        if on_gate is not None:
            on_gate(batch_id, gate)
        if gate["res"] != 1 and not force:
            return
        source = latest_version_before(spark, table_base, batch_id, initial_table)
        nxt = IM.snapshot_import(spark.read.parquet(source), batch, mapping)
        nxt.write.mode("overwrite").parquet(version_path(table_base, batch_id))

    return (uploads.writeStream.foreachBatch(per_batch)
            .option("checkpointLocation", checkpoint_location)
            .trigger(availableNow=True).start())


def weekly_receipts_stream(forecast_rows: DataFrame) -> DataFrame:
    """Streaming weekly split: rows ``(amount, r_day, <five ratios>)`` in,
    one row per week with the five exact sums out (complete/update mode)."""
    return FC.split_by_week(forecast_rows, "amount", "r_day")
