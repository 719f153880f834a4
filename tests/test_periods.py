import calendar
import datetime as dt

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from ledgerflow.functions import periods as P


def ladder(d):
    """Week-of-month end as the case ladder: day/7 <= 1..4, else month end."""
    n = d.day
    for k in range(1, 5):
        if n / 7 <= k:
            return dt.date(d.year, d.month, 7 * k)
    return dt.date(d.year, d.month, calendar.monthrange(d.year, d.month)[1])


def test_week_end_matches_ladder_on_every_day(spark):
    start, end = dt.date(2019, 12, 1), dt.date(2024, 12, 31)
    df = spark.sql(f"SELECT explode(sequence(DATE '{start}', DATE '{end}', INTERVAL 1 DAY)) AS d")
    got = {r.d: r.w for r in df.select("d", P.week_end("d").alias("w")).collect()}
    assert len(got) == (end - start).days + 1
    assert all(w == ladder(d) for d, w in got.items())


def test_week_end_edges_and_null(spark):
    days = [1, 7, 8, 14, 15, 21, 22, 28, 29, 30, 31]
    data = [(dt.date(2021, 1, n),) for n in days] + [(dt.date(2020, 2, 28),), (dt.date(2020, 2, 29),),
                                                     (dt.date(2021, 2, 28),), (None,)]
    df = spark.createDataFrame(data, "d date")
    out = {r.d: r.w for r in df.select("d", P.week_end("d").alias("w")).collect()}
    assert out[dt.date(2021, 1, 7)] == dt.date(2021, 1, 7)
    assert out[dt.date(2021, 1, 8)] == dt.date(2021, 1, 14)
    assert out[dt.date(2021, 1, 28)] == dt.date(2021, 1, 28)
    assert out[dt.date(2021, 1, 29)] == dt.date(2021, 1, 31)
    assert out[dt.date(2020, 2, 29)] == dt.date(2020, 2, 29)
    assert out[dt.date(2021, 2, 28)] == dt.date(2021, 2, 28)
    assert out[None] is None


def brute_week_number(d, weekday):
    x, n = dt.date(d.year, 1, 1), 0
    while x <= d:
        n += x.weekday() == weekday
        x += dt.timedelta(days=1)
    return n


@settings(max_examples=25, deadline=None)
@given(st.dates(dt.date(1990, 1, 1), dt.date(2040, 12, 31)), st.integers(0, 6))
def test_week_number_property(spark, d, k):
    got = spark.range(1).select(P.week_number(F.lit(d), k).alias("n")).first().n
    assert got == brute_week_number(d, k)


def test_weekday_number_and_dates(spark):
    df = spark.createDataFrame([("Monday",), ("Sunday",), ("Funday",)], "n string")
    assert dict(df.select("n", P.weekday_number("n")).collect()) == {"Monday": 0, "Sunday": 6,
                                                                     "Funday": None}
    fridays = spark.range(1).select(F.explode(P.weekday_dates(2021, 4)).alias("d")).collect()
    expect = [dt.date(2021, 1, 1) + dt.timedelta(days=i) for i in range(365)]
    assert [r.d for r in fridays] == [x for x in expect if x.weekday() == 4]


def test_is_valid_date(spark):
    cases = [(2021, 2, 30, False), (2020, 2, 29, True), (2021, 13, 1, False), (2021, 0, 5, False),
             (2021, 4, 31, False), (2021, 12, 31, True)]
    df = spark.createDataFrame([c[:3] for c in cases], "y int, m int, d int")
    got = [r.ok for r in df.select(P.is_valid_date("y", "m", "d").alias("ok")).collect()]
    assert got == [c[3] for c in cases]


def test_to_day_and_shift(spark):
    df = spark.createDataFrame([("2021-03-05 00:00:00",), ("not a date",), (None,)], "t string")
    got = [r.d for r in df.select(P.shift_days(P.to_day("t"), 30).alias("d")).collect()]
    assert got == [dt.date(2021, 4, 4), None, None]
