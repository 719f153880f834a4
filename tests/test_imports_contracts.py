import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerflow import fixed
from ledgerflow.operators import contracts as K
from ledgerflow.operators import forecast as FC
from ledgerflow.operators import imports as IM
from conftest import rows

UPLOAD = ("Buyer string, Style string, `PO Qty` double, `FOB/PC` double, Team string, OC string, "
          "`PO No` string, Color string, `Shipped Qty` double, `Ex-Fty Date` string")


def test_gate_thresholds(spark):
    under = spark.createDataFrame([("b", "s", 4199999.0, 1.0, None, None, "1", None, None, None),
                                   ("b", "s", 4200000.0, 1.0, None, None, "2", None, None, None),
                                   ("b", "s", None, 1.0, None, None, "3", None, None, None)], UPLOAD)
    r = IM.import_gate(under, "PO Qty", 8400000.0).first()
    assert (r.total, r.res, r.msg) == (8399999.0, 0, fixed.GATE_MESSAGE_SHORT)
    r = IM.import_gate(under, "PO Qty", 8399999.0).first()
    assert (r.res, r.msg) == (1, fixed.GATE_MESSAGE_OK)
    empty = spark.createDataFrame([], UPLOAD)
    r = IM.import_gate(empty, "PO Qty").first()
    assert (r.total, r.res) == (0.0, 0)


def test_quantity_check(spark):
    v = spark.createDataFrame([(1.0,), (2.0,)], "order_qty double")
    assert IM.quantity_check(v).first().chkfile == "Check File"
    assert IM.quantity_check(v, target=3.0).first().chkfile == ""


def test_snapshot_import(spark):
    current = spark.createDataFrame(
        [("B1", "S1", "P1", None, None, None, 2.0, 10.0, 2.0, 10.0, None, dt.date(2021, 1, 1), "Active")],
        "buyer string, style string, po_no string, color string, team string, oc string, fobpc double, "
        "po_qty double, fob_price double, order_qty double, shipped_qty double, exfty_date date, status string")
    upload = spark.createDataFrame([("B2", "S2", 5.0, 3.0, None, "oc1", "P2", None, None, "2021-02-03")], UPLOAD)
    out = {r.buyer: r for r in IM.snapshot_import(current, upload).collect()}
    assert out["B1"].status == "Inactive"
    n = out["B2"]
    assert (n.status, n.po_qty, n.order_qty, n.fob_price, n.team, n.oc, n.exfty_date) == \
        ("Active", 5.0, 5.0, 3.0, "0", "oc1", dt.date(2021, 2, 3))
    assert n.fobpc is None


def test_contract_checks(spark):
    df = spark.createDataFrame([("a", "Projected", 1), ("b", "Bogus", 2), (None, "Actual", 2),
                                ("  ", None, 3)], "name string, col_status string, col_no int")
    assert rows(K.required(df, "t", ["name"]), "value", "rows") == [("  ", 1), (None, 1)]
    assert rows(K.allowed_values(df, "t", {"col_status": fixed.COLUMN_STATUSES}), "value") == [("Bogus",)]
    assert rows(K.unique(df, "t", "col_no"), "value", "rows") == [("2", 2)]
    parent = spark.createDataFrame([("a",), ("b",)], "name string")
    child = spark.createDataFrame([("a",), ("z",), ("z",), (None,)], "name string")
    assert rows(K.foreign_key(child, "c", "name", parent, "name"), "value", "rows") == [("z", 2)]
    filled = K.with_defaults(spark.createDataFrame([(None,), ("USD",)], "currency string"),
                             {"currency": "BDT"})
    assert rows(filled) == [("BDT",), ("USD",)]


def test_bills_upload_gate_and_import(spark):
    bills_upload = spark.createDataFrame(
        [("B1", "ST1", 100.0, 2.5, "INV1", "PO1", "2021-05-06"),
         ("B2", "ST2", None, 3.0, "INV2", "PO2", "2021-05-07")],
        "Buyer string, `STYLE NO` string, `QTY-PCS` double, `UNIT PRICE` double, Invoice string, "
        "`PO NO` string, `EX-FTY DATE` string")
    g = IM.import_gate(bills_upload, fixed.BILLS_QTY_HEADER, 100.0).first()
    assert (g.total, g.res) == (100.0, 1)
    current = spark.createDataFrame(
        [("INV0", "B0", None, None, 1.0, 1.0, 1.0, dt.date(2021, 1, 1), "Active")],
        "invoice string, buyer string, style_no string, po_no string, qty_pcs double, "
        "unit_price double, total__fob_income double, ex_fty_date date, status string")
    out = {r.invoice: r for r in IM.snapshot_import(current, bills_upload, fixed.BILLS_UPLOAD_FIELDS,
                                                    date_fields=("ex_fty_date",)).collect()}
    assert out["INV0"].status == "Inactive"
    assert (out["INV2"].status, out["INV2"].qty_pcs, out["INV2"].ex_fty_date,
            out["INV2"].total__fob_income) == ("Active", 0.0, dt.date(2021, 5, 7), None)


def test_id_series_on_a_wide_table(spark):
    """Payload columns, null keys and many partitions: ids are 1..n in key order."""
    n = 400_000
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.when(F.col("id") % 50_000 != 0, F.col("id") % 977).alias("g"),
                               F.repeat(F.lit("x"), 40).alias("payload"), F.rand(3).alias("other"))
    out = K.id_series(df, ["g", "k"], "N%08d")
    want = out.withColumn("w", F.format_string("N%08d", F.row_number().over(Window.orderBy(F.col("g").asc_nulls_first(), "k"))))
    assert want.where("name <> w").count() == 0
    assert out.select("name").distinct().count() == n


def test_imported_text_numbers_and_unreadable_cells(spark):
    cur = spark.createDataFrame([("a", 1.0, 2.0, "Active")], "buyer string, order_qty double, fob_price double, status string")
    up = spark.createDataFrame([("b", "$10", "1"), ("c", "ten", None)], "Buyer string, `FOB/PC` string, `PO Qty` string")
    mapping = [("Buyer", "buyer"), ("FOB/PC", "fob_price"), ("PO Qty", "order_qty")]
    got = {r["buyer"]: (r["fob_price"], r["order_qty"]) for r in IM.snapshot_import(cur, up, mapping).where("status = 'Active'").collect()}
    assert got == {"b": (10.0, 1.0), "c": (None, 0.0)}
    assert [tuple(r) for r in IM.unreadable_numbers(up, mapping, cur.schema).collect()] == [("fob_price", "ten", 1)]


def test_imported_rows_keep_their_price_in_the_forecast(spark):
    row = spark.createDataFrame([(None, 5.0, 8.0, 8.0, None, "1996-01-01")],
                                "fobpc double, fob_price double, po_qty double, order_qty double, oc string, exfty_date string")
    assert FC.refresh_forecast_fields(row).first()["total"] == 40.0
    assert FC.refresh_forecast_fields(row, "literal").first()["total"] is None
