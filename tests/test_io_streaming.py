import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from ledgerflow import fixed
from ledgerflow.operators import reshape as RS
from ledgerflow.sources import sheets, sinks
from ledgerflow.sources import tables as TB
from ledgerflow.streaming import uploads

UPLOAD = ("Buyer string, Style string, `PO Qty` double, `FOB/PC` double, Team string, OC string, "
          "`PO No` string, Color string, `Shipped Qty` double, `Ex-Fty Date` string")


def test_sinks_and_sheet_round_trip(spark):
    base = tempfile.mkdtemp(prefix="lf-io-", dir="/tmp")
    df = spark.createDataFrame([(1, "Rent", "BDT", 5.0, None)],
                               "row_no int, Description string, Unit string, `2021-03-06` double, Apr double")
    sinks.export_sheet(df, f"{base}/sheet", single_file=True)
    back = sheets.read_sheet(spark, f"{base}/sheet", df.schema)
    long = RS.load_sheet_region(back, 1, 1)
    assert [tuple(r) for r in long.collect()] == [("Rent", "BDT", dt.date(2021, 3, 6), 5.0)]
    sinks.replace_table(df, f"{base}/t")
    sinks.append_rows(df, f"{base}/t")
    assert spark.read.parquet(f"{base}/t").count() == 2
    grown = spark.read.parquet(f"{base}/t").withColumn("Unit", F.lit("USD"))
    sinks.replace_from_itself(grown, f"{base}/t")
    assert [r.Unit for r in spark.read.parquet(f"{base}/t").collect()] == ["USD", "USD"]


def test_import_stream_versions(spark):
    base = tempfile.mkdtemp(prefix="lf-stream-", dir="/tmp")
    up = f"{base}/uploads"
    os.makedirs(up)
    initial = spark.createDataFrame(
        [("B0", "S0", "P0", None, None, None, 1.0, 1.0, 1.0, 1.0, None, dt.date(2021, 1, 1), "Active")],
        "buyer string, style string, po_no string, color string, team string, oc string, fobpc double, "
        "po_qty double, fob_price double, order_qty double, shipped_qty double, exfty_date date, status string")
    initial.write.parquet(f"{base}/initial")
    for i, qty in enumerate([10.0, 20.0]):
        spark.createDataFrame([(f"B{i+1}", "S", qty, 2.0, None, None, "P", None, None, "2021-02-01")],
                              UPLOAD).toPandas().to_csv(f"{up}/u{i}.csv", index=False)
    seen = []
    q = uploads.import_stream(spark, up, UPLOAD, f"{base}/table", f"{base}/initial", f"{base}/ckpt",
                              target=15.0, on_gate=lambda b, g: seen.append((b, g["res"])))
    q.awaitTermination(120)
    assert sorted(seen) == [(0, 0), (1, 1)]                   # first file is under the target
    latest = uploads.latest_version_before(spark, f"{base}/table", 10**6, "none")
    state = {r.buyer: r.status for r in spark.read.parquet(latest).collect()}
    assert state == {"B0": "Inactive", "B2": "Active"}


def test_weekly_stream(spark):
    base = tempfile.mkdtemp(prefix="lf-wstream-", dir="/tmp")
    schema = ("amount double, r_day date, margin double, bildup_unifill double, erq double, "
              "bildup_machine double, bildup_regular double")
    spark.createDataFrame([(100.0, dt.date(2021, 1, 2), 10.0, 5.0, 50.0, 2.0, 20.0)], schema) \
        .write.parquet(f"{base}/in/a")
    stream = spark.readStream.schema(schema).parquet(f"{base}/in/a")
    q = (uploads.weekly_receipts_stream(stream).writeStream.outputMode("complete").format("memory")
         .queryName("weekly_test").option("checkpointLocation", f"{base}/ck").start())
    q.processAllAvailable()
    got = spark.sql("SELECT * FROM weekly_test").collect()
    q.stop()
    assert len(got) == 1 and got[0]["Sales Proceeds - Margin A/C"] == 1000.0
    assert got[0].weekend == dt.date(2021, 1, 7)
    assert fixed.ACCOUNTS[0][1] == "Sales Proceeds - Margin A/C"


def test_replace_refuses_its_own_source_and_reads_see_appends(spark):
    import pytest
    base = tempfile.mkdtemp(prefix="lf-io-", dir="/tmp")
    sinks.replace_table(spark.range(10), f"{base}/t.parquet")
    before = spark.read.parquet(f"{base}/t.parquet")
    with pytest.raises(ValueError):
        sinks.replace_table(before.where("id > 3"), f"{base}/t.parquet")
    assert spark.read.parquet(f"{base}/t.parquet").count() == 10
    assert TB.read_table(spark, base, "t").count() == 10
    sinks.append_rows(spark.range(5), f"{base}/t.parquet")
    assert TB.read_table(spark, base, "t").count() == 15


def test_a_read_fault_is_not_an_empty_history(spark):
    import pytest
    base = tempfile.mkdtemp(prefix="lf-io-", dir="/tmp")
    assert uploads.latest_version_before(spark, f"{base}/none", 3, "first") == "first"
    os.makedirs(f"{base}/bad/version=00000001")
    open(f"{base}/bad/version=00000001/part-0.parquet", "w").write("no parquet")
    with pytest.raises(Exception):
        uploads.latest_version_before(spark, f"{base}/bad", 3, "first")


def test_a_cluster_without_a_shared_folder_is_refused():
    import pytest

    from ledgerflow import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        session.checkpoint_dir(Session())
