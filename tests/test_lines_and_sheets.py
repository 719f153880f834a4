"""Line numbers and records over splits, quarantine of uploads, schema-free sheets, grand totals."""
import csv
import io
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.operators import reshape as RS
from ledgerflow.plans import report as RP
from ledgerflow.sources import lines, sheets
from conftest import rows


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_lines_are_numbered_over_splits(spark, tmp_path, small_splits):
    random.seed(1)
    texts = [[f"{k} {'x' * random.randint(0, 60)}" if k % 9 else "" for k in range(n)] for n in (200, 1, 57)]
    for i, text in enumerate(texts):
        (tmp_path / f"f{i}.txt").write_text("\n".join(text) + "\n")
    got = lines.numbered(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() > 1 and lines._read(spark, str(tmp_path)).select("file", "split").distinct().count() > 20
    by_file = {}
    for r in got.collect():
        by_file.setdefault(r["file"].rsplit("/", 1)[1], []).append((r["line_no"], r["value"]))
    assert {f: [v for _, v in sorted(own)] for f, own in by_file.items()} == {f"f{i}.txt": t for i, t in enumerate(texts)}
    assert all(sorted(n for n, _ in own) == list(range(len(own))) for own in by_file.values())


def test_records_hold_line_breaks_also_across_splits(spark, tmp_path, small_splits):
    random.seed(2)
    want = [[str(k), "".join(random.choice(['a', 'b', '"', ",", "\n", "é"]) for _ in range(random.randint(0, 80))), "end"] for k in range(80)]
    text = io.StringIO()
    csv.writer(text, lineterminator="\n").writerows(want)
    (tmp_path / "sheet.csv").write_text(text.getvalue())
    texts = lines.records(spark, str(tmp_path / "sheet.csv")).orderBy("row_no").collect()
    assert [r["row_no"] for r in texts] == list(range(80))
    assert [next(csv.reader(io.StringIO(r["record"]))) for r in texts] == want


def test_good_and_rejected_lines_are_all_lines(spark, tmp_path):
    schema = T.StructType([T.StructField("no", T.StringType()), T.StructField("price", T.DoubleType()), T.StructField("day", T.DateType())])
    (tmp_path / "a.csv").write_text('no,price,day\n1,$2.50,2021-03-04\n2,many,2021-03-04\n3,1\n4,1,2021-03-04,x\n5,"1,2021-03-04\n"6, six",7,2021-13-40\n7,,\n\n')
    good, bad = sheets.read_upload_checked(spark, str(tmp_path), schema)
    assert [(r["no"], r["price"], str(r["day"])) for r in good.orderBy("no").collect() if r["no"]] == [("1", 2.5, "2021-03-04"), ("7", None, "None")]
    got = {r["line"]: [(p["field"], p["reason"]) for p in r["problems"]] for r in bad.collect()}
    assert got[3] == [("price", "not a number")] and got[4] == got[5] == [(None, "number of fields")]
    assert got[6] == [(None, "quote not closed")] and got[7] == [("day", "not a date")]
    assert good.count() + bad.count() == 8


def test_a_sheet_of_any_width_has_one_plan(spark):
    def sheet(n):
        return spark.range(3).select(F.col("id").cast("int").alias("row_no"), F.lit("d").alias("Description"), F.lit("USD").alias("Unit"),
                                     F.map_from_arrays(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: F.date_format(F.date_add(F.lit("2001-01-01"), k), "yyyy-MM-dd 00:00:00")),
                                                       F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: k.cast("double"))).alias("cells"))
    plans = []
    for n in (364, 10957):
        long = RS.region_to_long(sheet(n), 1, 2)
        assert long.count() == 2 * (n + 1) and long.columns == ["Descriptio", "Unit", "variable", "value"]
        plans.append(len(long._jdf.queryExecution().optimizedPlan().toString().splitlines()))
    assert plans[0] == plans[1]
    clash = spark.sql("select 1 as row_no, 'a' as Description, 'b' as Unit, map('2021-03-06 a', 1.0, '2021-03-06 b', 2.0) as cells")
    with pytest.raises(Exception, match="headers collide"):
        RS.region_to_long(clash).collect()
    assert rows(RS.region_to_long(clash, drop=["2021-03-06 b"]), "variable", "value") == [("2021-03-06", 1.0)]


def test_totals_are_told_apart_from_null_keys(spark):
    report = spark.createDataFrame([("B1", "x", 1.0, 10.1), ("B1", None, 2.0, 20.2), (None, "y", 4.0, 40.4), (None, None, 8.0, 80.8)],
                                   "bank string, buyer string, quantity double, amount double")
    assert rows(RP.forecast_totals(report)) == sorted([
        ("buyer", "B1", "x", 1.0, 10.1), ("buyer", "B1", None, 2.0, 20.2), ("buyer", None, "y", 4.0, 40.4), ("buyer", None, None, 8.0, 80.8),
        ("bank", "B1", None, 3.0, 30.3), ("bank", None, None, 12.0, 121.2), ("all", None, None, 15.0, 151.5)], key=lambda t: tuple((x is None, str(x)) for x in t))
