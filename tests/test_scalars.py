from pyspark.sql import functions as F

from ledgerflow.functions import scalars as S


def test_ratio_split_edge_cases(spark):
    df = spark.createDataFrame(
        [(100.0, "0"), (100.0, None), (100.0, ""), (100.0, "100"), (0.0, "20"), (-50.0, "20"),
         (None, "20"), (100.0, "$25")], "amount double, ratio string")
    got = [r.v for r in df.select(S.ratio_split("amount", S.number_of(df, "ratio")).alias("v")).collect()]
    assert got == [None, None, None, 100.0, 0.0, -250.0, None, 400.0]


def test_net_shipment_amount(spark):
    # gross 1000 -> 999; gross 2002.5 -> 2000.4975 -> 2000; 0.5005 -> 0.4999995 -> 0
    df = spark.createDataFrame([(10.0, 100.0), (2002.5, 1.0), (0.5005, 1.0), (1.0, 0.0)],
                               "p double, q double")
    got = [r.a for r in df.select(S.net_shipment_amount("p", "q").alias("a")).collect()]
    assert got == [999.0, 2000.0, 0.0, 0.0]


def test_net_bill_amount(spark):
    df = spark.createDataFrame([(1000.0,), (None,)], "a double")
    assert [r.x for r in df.select(S.net_bill_amount("a").alias("x")).collect()] == [999.0, None]


def test_fill_nulls_touches_text_and_numbers(spark):
    df = spark.createDataFrame([(None, None, "x")], "n double, t string, u string")
    r = S.fill_nulls(df).first()
    assert (r.n, r.t, r.u) == (0.0, "0", "x")


def test_first_present_skips_empty(spark):
    df = spark.createDataFrame([("", "2021-01-02", "2021-01-01"), (None, None, None)],
                               "a string, b string, c string")
    got = [r.v for r in df.select(S.first_present("a", "b", "c").alias("v")).collect()]
    assert got == ["2021-01-02", None]


def test_money_sum_is_exact(spark):
    df = spark.createDataFrame([(0.1,)] * 10 + [(0.2,)] * 5, "x double")
    assert df.agg(S.money_sum("x").cast("double").alias("s")).first().s == 2.0


def test_message_and_half(spark):
    df = spark.createDataFrame([(5.0,), (10.0,), (None,)], "q double")
    got = [r.m for r in df.select(S.below_target_message("q", F.lit(10.0)).alias("m")).collect()]
    assert got == ["Check File", "", ""]
    assert df.select(S.half("q").alias("h")).first().h == 2.5
