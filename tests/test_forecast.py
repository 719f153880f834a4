import datetime as dt

from ledgerflow import fixed
from ledgerflow.operators import forecast as FC
from conftest import rows

RATIOS = "margin double, bildup_unifill double, erq double, bildup_machine double, bildup_regular double"


def test_weekly_split_against_hand_computation(spark):
    data = [(1000.0, dt.date(2021, 4, 3), 10.0, 5.0, 50.0, 0.0, 20.0),
            (500.0, dt.date(2021, 4, 7), 20.0, 5.0, 50.0, 2.0, 25.0),
            (300.0, dt.date(2021, 4, 30), 10.0, 6.0, 50.0, 4.0, 20.0),
            (100.0, None, 10.0, 5.0, 50.0, 2.0, 20.0)]
    df = spark.createDataFrame(data, f"amount double, r_day date, {RATIOS}")
    weekly = {r.weekend: r for r in FC.split_by_week(df, "amount", "r_day").collect()}
    w = weekly[dt.date(2021, 4, 7)]
    assert w["Sales Proceeds - Margin A/C"] == 1000 / 10 * 100 + 500 / 20 * 100
    assert w["Sales Proceeds - Build Up A/C (Machinery payment)"] == 500 / 2 * 100   # ratio 0 -> NULL, skipped
    assert weekly[dt.date(2021, 4, 30)]["Sales Proceeds - ERQ A/C"] == 600.0
    assert None in weekly                                                          # null week kept
    long = FC.weekly_to_long(FC.split_by_week(df, "amount", "r_day"))
    assert long.columns == ["variable", "Unit", "Descriptio", "value"]
    assert long.count() == 3 * 5


def test_bills_status_filters(spark):
    terms = spark.createDataFrame([("B1", 30, 10.0, 5.0, 50.0, 2.0, 20.0)],
                                  f"buyer_name string, realised_day int, {RATIOS}")
    bills = spark.createDataFrame(
        [("1", "B1", 1000.0, None, None, dt.date(2021, 1, 1), None, None, None, "OPEN"),
         ("2", "B1", None, 10.0, 5.0, dt.date(2021, 1, 1), dt.date(2021, 2, 1), None,
          dt.date(2021, 3, 1), "fully realized"),
         ("3", "B1", 1000.0, None, None, dt.date(2021, 1, 1), None, None, None, None)],
        "invoice string, buyer string, total__fob_income double, qty_pcs double, unit_price double,"
        " ex_fty_date date, ex1 date, ex2 date, ex3 date, status string")
    view = FC.bills_view(bills, terms)
    r = {x.invoice: x for x in view.collect()}
    assert r["1"].r_day == dt.date(2021, 1, 31)          # ex-factory + 30 days
    assert r["2"].r_day == dt.date(2021, 3, 1)           # revised ex3 wins
    assert r["2"].total__fob_income == 50.0              # qty x price when amount missing
    open_ = FC.bills_forecast_weekly(view).where("value IS NOT NULL")
    done = FC.bills_actual_weekly(view).where("value IS NOT NULL")
    assert {x.variable for x in open_.collect()} == {dt.date(2021, 1, 31)}   # NULL status dropped
    assert {x.variable for x in done.collect()} == {dt.date(2021, 3, 7)}   # week end of Mar 1


def test_fund_flow_full_outer(spark):
    a = spark.createDataFrame([(dt.date(2021, 1, 7), "USD", d, 1.0) for _, d in fixed.ACCOUNTS],
                              "variable date, Unit string, Descriptio string, value double")
    b = spark.createDataFrame([(dt.date(2021, 1, 14), "USD", d, 2.0) for _, d in fixed.ACCOUNTS],
                              a.schema)
    ff = FC.fund_flow(a, b)
    assert ff.count() == 2
    assert len(ff.columns) == 11
    r = {x.variable: x.asDict() for x in ff.collect()}
    assert r[dt.date(2021, 1, 7)]["Sales Proceeds - ERQ A/C_y"] is None


def test_early_split_drops_null_rows(spark):
    df = spark.createDataFrame([(100.0, dt.date(2021, 1, 2), 10.0, 5.0, 50.0, 2.0, 20.0, "x"),
                                (100.0, dt.date(2021, 1, 3), 10.0, 5.0, 50.0, 2.0, 20.0, None)],
                               f"amount double, r_day date, {RATIOS}, status string")
    out = rows(FC.early_weekly_split(df, "amount", "r_day"))
    assert out == [("2021-01-07", 1000.0, 2000.0, 200.0, 5000.0, 500.0)]


def test_early_split_excludes_handover(spark):
    df = spark.createDataFrame([(100.0, dt.date(2021, 1, 2), 10.0, 5.0, 50.0, 2.0, 20.0, "BUC"),
                                (100.0, dt.date(2021, 1, 3), 10.0, 5.0, 50.0, 2.0, 20.0, "SF")],
                               f"amount double, r_day date, {RATIOS}, considerable_handover string")
    out = rows(FC.early_weekly_split(df, "amount", "r_day"))
    assert out == [("2021-01-07", 1000.0, 2000.0, 200.0, 5000.0, 500.0)]


def test_share_option(spark):
    df = spark.createDataFrame([(200.0, dt.date(2021, 1, 2), 10.0, 5.0, 50.0, 2.0, 20.0)],
                               f"amount double, r_day date, {RATIOS}")
    w = FC.split_by_week(df, "amount", "r_day", share=True).first()
    assert w["Sales Proceeds - Margin A/C"] == 20.0 and w["Sales Proceeds - ERQ A/C"] == 100.0


def test_dimension_join_salted_path_matches_broadcast(spark):
    from ledgerflow.operators.joins import dimension_join
    fact = spark.createDataFrame([("hot", i) for i in range(200)] + [("cold", 1), ("none", 2)],
                                 "buyer string, n int")
    dim = spark.createDataFrame([("hot", 30), ("cold", 45)], "buyer_name string, days int")
    a = dimension_join(fact, dim, ["buyer"], ["buyer_name"])
    b = dimension_join(fact, dim, ["buyer"], ["buyer_name"], buckets=8)
    assert b.columns == a.columns
    assert rows(a) == rows(b) and len(rows(b)) == 201


def test_a_large_dimension_is_hashed_and_the_facts_are_not_sorted(spark, monkeypatch):
    from ledgerflow.operators import joins as J
    fact = spark.range(300).selectExpr("cast(if(id % 3 = 0, 7, id * 400) as string) AS buyer", "cast(id as int) AS n")
    fact = fact.unionByName(spark.createDataFrame([(None, 1), ("none", 2)], "buyer string, n int"))
    dim = spark.range(110_000).selectExpr("cast(id as string) AS buyer_name", "cast(id % 90 as int) AS days")
    dim = dim.unionByName(spark.createDataFrame([("7", -1), (None, 5)], "buyer_name string, days int"))   # a buyer twice
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        want = rows(fact.join(dim, fact.buyer == dim.buyer_name))
        for task in (J.ROWS_OF_A_TASK, 10_000):       # the session's 4 partitions, then 12
            monkeypatch.setattr(J, "ROWS_OF_A_TASK", task)
            got = J.dimension_join(fact, dim, ["buyer"], ["buyer_name"])
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "ShuffledHashJoin" in plan and "Sort" not in plan
            assert plan.count("hashpartitioning") == 2 and (", 12)" in plan) == (task == 10_000)
            assert rows(got) == want and len(want) > 300
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
