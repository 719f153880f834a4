import datetime as dt

import pytest

from ledgerflow.operators import reshape as RS
from conftest import rows


def sheet(spark):
    return spark.createDataFrame(
        [(1, "Rent", "BDT", 10.0, None, 1.0, None, None),
         (2, "Power", "BDT", None, 5.0, 2.0, None, None),
         (3, "Water", "BDT", 1.0, 1.0, 3.0, None, None)],
        "row_no int, Description string, Unit string, `2021-03-06 00:00:00` double, "
        "`2021-03-13 00:00:00` double, `2021-03-20` double, Apr double, May double")


def test_region_headers_and_long(spark):
    long = RS.load_sheet_region(sheet(spark), 1, 2)
    assert long.columns == ["Descriptio", "Unit", "variable", "value"]
    got = rows(long)
    assert len(got) == 6                                   # 2 rows x 3 date columns, nulls kept
    assert ("Rent", "BDT", dt.date(2021, 3, 13), None) in got
    assert ("Power", "BDT", dt.date(2021, 3, 20), 2.0) in got


def test_header_collision_is_an_error(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "`2021-03-06 a` double, `2021-03-06 b` double")
    with pytest.raises(ValueError):
        RS.normalise_headers(df)


def test_pivot_round_trip_and_duplicate_key(spark):
    long = spark.createDataFrame([("w1", "a", 1.0), ("w1", "b", None), ("w2", "a", 3.0)],
                                 "variable string, Descriptio string, value double")
    wide = RS.long_to_wide(long, "variable", "Descriptio", "value", ["a", "b"])
    assert rows(wide) == [("w1", 1.0, None), ("w2", 3.0, None)]
    back = RS.wide_to_long(wide, ["variable"], ["a", "b"], "Descriptio", "value")
    assert rows(back) == rows(long.unionByName(
        spark.createDataFrame([("w2", "b", None)], long.schema)))
    dup = long.unionByName(spark.createDataFrame([("w1", "a", 9.0)], long.schema))
    with pytest.raises(Exception):
        RS.long_to_wide(dup, "variable", "Descriptio", "value", ["a", "b"]).collect()


def test_region_skips_leading_columns(spark):
    df = spark.createDataFrame([(1, "01", "ACC", "Rent", "BDT", 4.0, None)],
                               "row_no int, SL string, ACC string, Description string, Unit string, "
                               "`2021-03-06` double, Apr double")
    long = RS.load_sheet_region(df, 1, 1, from_column=2)
    assert [tuple(r) for r in long.collect()] == [("Rent", "BDT", dt.date(2021, 3, 6), 4.0)]
