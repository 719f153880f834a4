import datetime as dt

from hypothesis import given, settings, strategies as st

from ledgerflow.operators import balances as B
from ledgerflow.sources import tables as TB

CELLS = "report_line string, report_col string, col_index int, ex_date date, month string, line_name string, group_no string, amount double"


def weekly_columns(spark, n):
    rows_ = []
    for i in range(n):
        d1 = dt.date(1996, 1, 1) + dt.timedelta(days=7 * i)
        rows_.append((f"C{i}", 2 * i + 1, "January", d1, d1 + dt.timedelta(days=6), False, "Projected"))
    return TB.local_frame(spark, rows_, TB.COLUMNS_SCHEMA)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 50)), min_size=1, max_size=12))
def test_roll_forward_matches_loop(spark, flows):
    cols = weekly_columns(spark, len(flows))
    cells = []
    for i, (inflow, outflow) in enumerate(flows):
        d2 = dt.date(1996, 1, 7) + dt.timedelta(days=7 * i)
        if inflow:
            cells.append(("CFRL0132", f"C{i}", 2 * i + 1, d2, "January", "in", None, float(inflow)))
        if outflow:
            cells.append(("CFRL0171", f"C{i}", 2 * i + 1, d2, "January", "out", None, float(outflow)))
    df = spark.createDataFrame(cells, CELLS)
    out = B.balance_roll_forward(df, TB.report_lines(spark), cols)
    got = {(r.report_line, r.report_col): r.amount for r in out.where(
        "report_line IN ('CFRL0120', 'CFRL0185')").collect()}
    closing = 0
    for i, (inflow, outflow) in enumerate(flows):
        opening = closing
        closing = max(0, closing + inflow - outflow)
        assert got.get(("CFRL0120", f"C{i}"), 0) == opening
        assert got.get(("CFRL0185", f"C{i}"), 0) == closing


def test_literal_openings_miss_short_last_bucket(spark):
    cols = TB.local_frame(spark, [
        ("A", 1, "April", dt.date(1996, 4, 22), dt.date(1996, 4, 28), False, "Projected"),
        ("B", 3, "April", dt.date(1996, 4, 29), dt.date(1996, 4, 30), False, "Projected"),
        ("C", 5, "May", dt.date(1996, 5, 1), dt.date(1996, 5, 7), False, "Projected"),
        ("D", 7, "May", dt.date(1996, 5, 8), dt.date(1996, 5, 14), False, "Projected")], TB.COLUMNS_SCHEMA)
    cells = spark.createDataFrame([
        ("CFRL0185", "A", 1, dt.date(1996, 4, 28), "April", "x", None, 10.0),
        ("CFRL0185", "B", 3, dt.date(1996, 4, 30), "April", "x", None, 20.0),
        ("CFRL0185", "C", 5, dt.date(1996, 5, 7), "May", "x", None, 30.0)], CELLS)
    got = {r.report_col: r.amount for r in B.opening_balances(cells, TB.report_lines(spark), cols).collect()}
    assert "B" not in got          # 7-day window (Apr 22, Apr 23] misses Apr 28
    assert got["C"] == 20.0        # month edge: bucket 5 -> bucket 1 is found
    assert got["D"] == 30.0


def test_gap_column_and_one_column_account(spark):
    cols = weekly_columns(spark, 3)
    cells = spark.createDataFrame([
        ("CFRL0145", "C0", 1, dt.date(1996, 1, 7), "January", "in", None, 40.0),    # cash account
        ("CFRL0172", "C2", 5, dt.date(1996, 1, 21), "January", "out", None, 15.0),  # C1 is a gap
        ("CFRL0140", "C1", 3, dt.date(1996, 1, 14), "January", "in", None, 8.0)],   # welfare, once
        CELLS)
    out = {(r.report_line, r.report_col): r.amount
           for r in B.balance_roll_forward(cells, TB.report_lines(spark), cols).collect()}
    assert out[("CFRL0186", "C0")] == 40.0 and out[("CFRL0186", "C1")] == 40.0   # carried over the gap
    assert out[("CFRL0121", "C2")] == 40.0 and out[("CFRL0186", "C2")] == 25.0
    assert out[("CFRL0187", "C1")] == 8.0 and out[("CFRL0187", "C2")] == 8.0
    assert ("CFRL0187", "C0") not in out                                         # zero is not stored
    initial = spark.createDataFrame([("CFRL0188", "Projected", 5.0)],
                                    "account string, col_status string, opening double")
    out2 = {(r.report_line, r.report_col): r.amount for r in
            B.balance_roll_forward(cells, TB.report_lines(spark), cols, initial).collect()}
    assert out2[("CFRL0123", "C0")] == 5.0 and out2[("CFRL0188", "C2")] == 5.0   # opening carried


def test_month_column_takes_first_opening_and_last_closing(spark):
    rows_ = [(f"C{i}", 2 * i + 1, "January", dt.date(1996, 1, 1) + dt.timedelta(days=7 * i),
              dt.date(1996, 1, 7) + dt.timedelta(days=7 * i), False, "Projected") for i in range(3)]
    rows_.append(("M1", 1001, "January", dt.date(1996, 1, 1), dt.date(1996, 1, 31), True, "Projected"))
    cols = TB.local_frame(spark, rows_, TB.COLUMNS_SCHEMA)
    cells = spark.createDataFrame([
        ("CFRL0132", "C0", 1, dt.date(1996, 1, 7), "January", "in", None, 30.0),
        ("CFRL0132", "C1", 3, dt.date(1996, 1, 14), "January", "in", None, 12.0),
        ("CFRL0171", "C2", 5, dt.date(1996, 1, 21), "January", "out", None, 2.0)], CELLS)
    initial = spark.createDataFrame([("CFRL0185", "Projected", 5.0)],
                                    "account string, col_status string, opening double")
    out = {(r.report_line, r.report_col): r.amount for r in
           B.balance_roll_forward(cells, TB.report_lines(spark), cols, initial).collect()}
    assert out[("CFRL0120", "M1")] == 5.0           # opening of the first week
    assert out[("CFRL0185", "M1")] == 45.0          # 5 + 30 + 12 - 2, closing of the last week
