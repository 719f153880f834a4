import datetime as dt

from ledgerflow.operators import rules as RU
from ledgerflow.sources import tables as TB
from conftest import rows

LEDGER = "expenses_date date, main_account string, expenses_head string, currency string, amount double, week_date date"


def cols(spark, rows_):
    return TB.local_frame(spark, rows_, TB.COLUMNS_SCHEMA)


def test_cell_rules_edge_cases(spark):
    rules = spark.createDataFrame(
        [("Projected", "A", "expenses_forecast", "head", "Key A", None),
         ("Projected", "B", "expenses_forecast", "account", "Acc B", None),
         ("Projected", "C", "expenses_forecast", "head", "Wrong Dim", None),
         ("Projected", "D", "income_forecast", "head", "D", "usd_per_thousand")],
        "col_status string, line_name string, source string, dim string, key string, scale string")
    lines = TB.local_frame(spark, [("L1", "R", "1", "A", "BDT", 1), ("L2", "R", "1", "B", "BDT", 2),
                                   ("L3", "R", "1", "C ", "BDT", 3), ("L4", "R", "1", "D", "BDT", 4)],
                           TB.LINES_SCHEMA)
    columns = cols(spark, [("W1", 1, "March", dt.date(2021, 3, 1), dt.date(2021, 3, 7), False, "Projected"),
                           ("M1", 1001, "March", dt.date(2021, 3, 1), dt.date(2021, 3, 31), True, "Projected"),
                           ("D1", 3, "March", dt.date(2021, 3, 9), dt.date(2021, 3, 9), False, "Projected"),
                           ("A1", 2, "March", dt.date(2021, 3, 1), dt.date(2021, 3, 7), False, "Actual")])
    ef = spark.createDataFrame([
        (dt.date(2021, 3, 2), "x", "Key A ", "BDT", 10.0, None),        # trailing space matches
        (dt.date(2021, 3, 9), "x", "Key A", "BDT", 5.0, None),          # single-day column
        (dt.date(2021, 3, 3), "Acc B", "Key  A", "BDT", 7.0, None),     # two inner spaces: no match
        (dt.date(2021, 3, 4), "Acc B", "y", "BDT", -20.0, None),        # negative sum dropped
        (dt.date(2021, 3, 5), "Wrong Dim", "z", "BDT", 3.0, None)],     # key sits in the account
        LEDGER)
    inc = spark.createDataFrame([(dt.date(2021, 3, 20), "x", "D", "BDT", 2000.0, dt.date(2021, 3, 21))],
                                LEDGER)
    empty = spark.createDataFrame([], LEDGER)
    ship = spark.createDataFrame([], "shipment_date date, shipment_type string, quentity double, amount double, week_date date")
    fpi = spark.createDataFrame([], "Descriptio string, variable date, value double")
    sources = RU.report_sources(inc, empty, ef, empty, ship, fpi)
    cells = RU.base_cells(sources, rules, lines, columns, usd_rate=84.5)
    got = rows(cells, "report_line", "report_col", "amount")
    assert got == [("L1", "D1", 5.0), ("L1", "M1", 15.0), ("L1", "W1", 10.0),
                   ("L4", "M1", 169.0)]                 # 84.5 * 2000 / 1000; B negative; C no match
    lint = rows(RU.unmatched_rules(rules, sources), "line_name")
    assert lint == [("C",)]


def test_dead_rules_against_option_lists(spark):
    options = TB.local_frame(spark, RU.ledger_option_rows(), "source string, dim string, value string")
    dead = rows(RU.rules_outside_options(TB.rules(spark), options), "col_status", "line_name")
    assert dead == [("Actual", "EOT"),
                    ("Projected", "Bank Charge (Mother A/C)"),
                    ("Projected", "Finance/Interest Expenses (Mother A/C)"),
                    ("Projected", "Received in L/O Account Bank"),
                    ("Projected", "Received in Zakat Account")]


def test_report_columns_of_any_year(spark):
    """A year of 28 February days has four weeks in that month, numbered through."""
    for year, weeks in ((1996, 60), (1997, 59), (2000, 60)):
        c = TB.report_columns(spark, year).collect()
        weekly = sorted((r for r in c if not r["ismonth"]), key=lambda r: r["col_no"])
        assert [r["col_no"] for r in weekly] == list(range(1, 2 * weeks + 1))
        for status in ("Projected", "Actual"):
            days = [d for r in weekly if r["col_status"] == status
                    for d in (r["date1"] + dt.timedelta(k) for k in range((r["date2"] - r["date1"]).days + 1))]
            assert days == [dt.date(year, 1, 1) + dt.timedelta(k) for k in range(366 if weeks == 60 else 365)]
        assert len([r for r in c if r["ismonth"]]) == 24
    two = TB.report_columns(spark, 1996, 1997)
    assert two.where("not ismonth").count() == 2 * 119 and two.select("name").distinct().count() == two.count()


def test_configuration_is_read_from_tables(spark, tmp_path):
    from ledgerflow.sources import domain
    at = str(tmp_path)
    TB.settings(spark, usd_rate=90.0).write.parquet(f"{at}/settings.parquet")
    TB.report_columns(spark, 1997).where("col_status = 'Actual'").write.parquet(f"{at}/report_columns.parquet")
    config = domain.load_config(spark, at)
    assert config["settings"].first()["usd_rate"] == 90.0
    assert config["report_columns"].where("col_status = 'Projected'").count() == 0
    assert config["rules"].count() == TB.rules(spark).count()


def test_nothing_runs_while_the_report_is_planned(spark):
    from ledgerflow.operators import balances as B
    from ledgerflow.plans import report as RP
    inp = RP.inputs_from_dir(spark, "/root/testdata/sf0.001", 1996)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "planning")
    try:
        cells = RP.base_cells(inp)
        RP.revised_date_impact(inp.tables["bills_under_collection"], cells)
        B.opening_balances(cells, inp.lines, inp.columns)
        assert list(tracker.getJobIdsForGroup("planning")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
