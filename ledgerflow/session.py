"""Spark session construction and shared-folder helpers.

Everything in the library takes a ``SparkSession`` as an argument; this module
only builds one for tests, the bench and the command line, with the settings the
operators are written for (AQE with skew-join splitting, UTC, no web UI).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "ledgerflow", cpus: int | str = "*",
                  shuffle_partitions: int | None = None,
                  driver_memory: str = "16g") -> SparkSession:
    """Local session for tests and the bench. On a cluster, pass an existing
    session to the operators instead; nothing here is required by them."""
    parts = shuffle_partitions or (8 if cpus == "*" else max(int(cpus), 2))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _one_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    The session's ``spark.checkpoint.dir`` wins. Only when it is unset (local
    tests) a fresh scratch folder is created and registered; any other master
    without the setting is an error, as a machine-local path serves one machine.
    """
    current = spark.conf.get(CHECKPOINT_KEY, None)
    if not current:
        current = spark.sparkContext.getCheckpointDir() if hasattr(
            spark.sparkContext, "getCheckpointDir") else None
    if not current and not _one_machine(spark.sparkContext.master):
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
    if not current:
        current = tempfile.mkdtemp(prefix="ledgerflow-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set(CHECKPOINT_KEY, current)
    if not (spark.sparkContext.getCheckpointDir() or "").startswith(("file:" + current, current)):
        spark.sparkContext.setCheckpointDir(current)      # makes a folder of its own, once
    return current


def materialize(df):
    """Cut lineage of a small intermediate that several passes read: an eager
    reliable checkpoint into the shared ``spark.checkpoint.dir``. The report
    cells (lines x columns) are written once instead of every roll-up level
    re-scanning the ledgers."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df, name):
    """``df`` written as Parquet into the shared folder and read back by its schema: lineage is
    cut, columns are still pruned, and the files outlive any executor."""
    at = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
