"""Interval index, places in a total order, versioned tables, member tables, incremental report."""
import datetime as dt
import os
import random
from dataclasses import dataclass, replace

import pytest
from pyspark.sql import functions as F

from ledgerflow import fixed
from ledgerflow.operators import intervals as I
from ledgerflow.operators import ranking
from ledgerflow.operators import rollup as R
from ledgerflow.operators import versions as V
from ledgerflow.operators import rules as RU
from ledgerflow.plans import incremental as INC
from ledgerflow.plans import report as RP
from ledgerflow.sources import tables as TB
from conftest import rows

EPOCH = dt.date(1970, 1, 1)


def test_ranges_are_few_blocks_and_days_meet_each_range_once(spark):
    random.seed(1)
    ranges = []
    for k in range(300):
        n = random.choice([1, 1, 2, 7, 31, 366, 7305])
        a = EPOCH + dt.timedelta(random.randint(-2000, 9000))
        ranges.append((k, k % 2, a, a + dt.timedelta(n - 1)))
    ranges += [(900, 0, dt.date(2001, 1, 2), dt.date(2001, 1, 1)), (901, 0, None, dt.date(2001, 1, 1))]
    rf = spark.createDataFrame(ranges, "id int, side int, a date, b date")
    per = {r["id"]: r["n"] for r in I.indexed(rf, "a", "b").groupBy("id").agg(F.count("*").alias("n")).collect()}
    for k, _, a, b in ranges[:300]:
        n = (b - a).days + 1
        assert per[k] <= max(1, 2 * (n.bit_length()))
    assert 900 not in per and 901 not in per
    days = [(j, random.randint(0, 1), EPOCH + dt.timedelta(random.randint(-2100, 17000))) for j in range(400)] + [(999, 0, None)]
    got = I.day_join(spark.createDataFrame(days, "day_id int, side int, day date"), "day", rf, "a", "b", ["side"])
    want = sorted((j, k) for j, s, d in days if d for k, t, a, b in ranges if a and s == t and a <= d <= b)
    assert sorted((r["day_id"], r["id"]) for r in got.collect()) == want and len(want) > 500


def test_columns_of_one_day_and_of_twenty_years(spark):
    columns = TB.local_frame(spark, [("L", 1, "x", dt.date(2001, 1, 1), dt.date(2020, 12, 31), False, "Actual"),
                                     ("D", 3, "x", dt.date(2010, 5, 5), dt.date(2010, 5, 5), False, "Actual")], TB.COLUMNS_SCHEMA)
    assert RU.column_blocks(columns).count() <= 2 * 13 + 1
    lines = TB.local_frame(spark, [("L1", "R", "1", "A", "BDT", 1)], TB.LINES_SCHEMA)
    rules = spark.createDataFrame([("Actual", "A", "income_actual", "head", "A", None)], "col_status string, line_name string, source string, dim string, key string, scale string")
    days = [EPOCH + dt.timedelta(10950 + 3 * k) for k in range(3000)] + [dt.date(2010, 5, 5)] * 2
    src = spark.createDataFrame([("income_actual", "A", "x", d, 1.0) for d in days], "source string, Descriptio string, account string, variable date, amount double")
    got = rows(RU.base_cells(src, rules, lines, columns), "report_col", "amount")
    assert got == [("D", float(sum(d == dt.date(2010, 5, 5) for d in days))), ("L", float(sum(dt.date(2001, 1, 1) <= d <= dt.date(2020, 12, 31) for d in days)))]


def test_places_are_row_numbers_and_ranges_are_even(spark):
    n = 20000
    df = spark.range(n).select(F.when(F.col("id") % 10 < 3, F.lit(5)).otherwise(F.pmod(F.xxhash64("id"), F.lit(997))).cast("int").alias("day"),
                               F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("no"), F.lit(1).alias("same")).repartition(5)
    got = ranking.with_place(df, ["day", "no"], ranges=8).collect()
    assert sorted(r["place"] for r in got) == list(range(n))
    key = lambda r: (r["day"], r["no"] is not None, r["no"] or "")
    ordered = sorted(got, key=lambda r: r["place"])
    assert all(key(a) <= key(b) for a, b in zip(ordered, ordered[1:]))
    # three rows of ten are of one day, and equal rows are very many
    for same in (df, df.select("day", "same")):
        sizes = [r["n"] for r in ranking.in_ranges(same, ["day"], 8).groupBy("_range").agg(F.count("*").alias("n")).collect()]
        assert len(sizes) == 8 and max(sizes) <= 2 * n / 8
    assert ranking.with_place(df.limit(0), ["day"]).count() == 0


def files(at):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(at) for f in names if f.endswith(".parquet")}


def test_imports_leave_older_partitions_untouched(spark, tmp_path):
    mapping = [("No", "no"), ("Price", "price")]
    table = spark.createDataFrame([("a", 1.0, "Active"), ("b", 2.0, "Inactive")], "no string, price double, status string")
    at = V.create(table, str(tmp_path / "t"))
    upload = spark.createDataFrame([("c", "$3"), ("d", None)], "No string, Price string")
    assert rows(V.history(spark, at), "no", "status") == [("a", "Active"), ("b", "Inactive")]
    before = files(f"{at}/rows")
    assert V.import_upload(upload, at, mapping, date_fields=()) == 1
    middle = files(f"{at}/rows")
    assert before.items() <= middle.items() and len(middle) > len(before)
    assert V.import_upload(upload.repartition(2), at, mapping, date_fields=()) == 1          # the same upload again
    assert files(f"{at}/rows") == middle
    assert V.import_upload(upload.limit(1), at, mapping, date_fields=()) == 2
    assert middle.items() <= files(f"{at}/rows").items()
    assert rows(V.history(spark, at), "no", "price", "status", "version") == [
        ("a", 1.0, "Inactive", 0), ("b", 2.0, "Inactive", 0), ("c", 3.0, "Active", 2), ("c", 3.0, "Inactive", 1), ("d", 0.0, "Inactive", 1)]
    assert rows(V.current(spark, at), "no", "status") == [("c", "Active")]
    # a run that died before its number was listed leaves no trace, and its rerun takes the same number
    V.put_partitions(table.withColumn("version", F.lit(3).cast("long")), f"{at}/rows", "version")
    assert V.history(spark, at).count() == 5
    assert V.import_upload(upload, at, mapping, date_fields=()) == 3
    assert rows(V.current(spark, at), "no") == [("c",), ("d",)]


def test_batches_are_appended_once(spark, tmp_path):
    at = str(tmp_path / "b")
    for batch, n in (("x", 3), ("y", 2), ("x", 3)):
        V.append_batch(spark.range(n), at, batch)
    assert rows(spark.read.parquet(at), "batch", "id") == [("x", 0), ("x", 1), ("x", 2), ("y", 0), ("y", 1)]


def test_levels_of_a_member_table(spark):
    mem = spark.createDataFrame([("t3", "t2", 1), ("t2", "t1", 1), ("t2", "a", -1), ("t1", "b", 1), ("t4", "t3", 1), ("t4", "t1", 1), ("u", "c", 1)],
                                "total_line string, member_line string, sign int")
    levelled, n = R.with_levels(mem)
    assert n == 4
    assert dict(rows(levelled, "total_line", "level")) == {"t1": 1, "t2": 2, "t3": 3, "t4": 4, "u": 1}
    assert R.with_levels(mem.limit(0))[1] == 0
    cycle = mem.unionByName(spark.createDataFrame([("t1", "t4", 1)], mem.schema))
    with pytest.raises(ValueError, match="t1"):
        R.with_levels(cycle)
    with pytest.raises(ValueError, match="u"):
        R.with_levels(mem.unionByName(spark.createDataFrame([("u", "u", 1)], mem.schema)))


def test_the_built_in_levels_are_those_of_the_table(spark):
    built_in = R.members(spark)
    levelled, _ = R.with_levels(built_in.drop("level"))
    assert rows(levelled.distinct(), "total_line", "member_line", "sign", "level") == rows(built_in.distinct(), "total_line", "member_line", "sign", "level")


def ledger(random_, n, heads, first=dt.date(1997, 1, 1)):
    return [(random_.choice(["income_actual", "expenses_actual"]), random_.choice(heads), random_.choice(heads),
             first + dt.timedelta(random_.randint(0, 150)), round(random_.uniform(-50, 400), 2)) for _ in range(n)]


@dataclass
class Booked(RP.ReportInputs):
    """Inputs whose ledgers are one frame."""
    book: object = None

    def sources(self, prune=None, only=None):
        return self.book


def test_increments_equal_the_rebuild(spark, tmp_path):
    rnd = random.Random(4)
    heads = sorted({key or line for status, line, source, _, key in fixed.RULES if source in ("income_actual", "expenses_actual")})
    schema = "source string, Descriptio string, account string, variable date, amount double"
    book = ledger(rnd, 400, heads)
    none = spark.createDataFrame([], schema)
    inp = Booked(terms=none, tables={}, rules=TB.rules(spark), lines=TB.report_lines(spark), columns=TB.report_columns(spark, 1997), usd_rate=85.0)
    at = str(tmp_path / "state")
    of = lambda r: spark.createDataFrame(r, schema) if r else none
    INC.build(replace(inp, book=of(book)), at)               # afterwards the ledgers are not read: there are none
    for step in range(1, 4):
        gone = rnd.sample(book, 6 if step < 3 else 0)
        late = ledger(rnd, 5 if step < 3 else 0, heads, dt.date(1997, 1 + 2 * step, 1))
        fixed_rows = [(s, h, a, d, x + 7) for s, h, a, d, x in gone[:3]]
        for r in gone:
            book.remove(r)
        book += late + fixed_rows
        got = INC.apply(inp, at, INC.signed_sums(of(late + fixed_rows), of(gone)))
        again = INC.apply(inp, at, INC.signed_sums(of(late + fixed_rows), of(gone)), step=step)      # the step run again
        want = rows(RP.full_report(replace(inp, book=of(book))))
        assert rows(got) == want and rows(again) == want and len(want) > 300
    assert INC.last_step(spark, at) == 3


def test_layers_of_sums_are_not_merged_key_by_key_for_the_cells(spark, tmp_path, monkeypatch):
    schema = "source string, Descriptio string, account string, variable date, amount double"
    head = next((key or line).strip() for status, line, source, _, key in fixed.RULES if source == "income_actual")
    of = lambda r: spark.createDataFrame(r, schema)
    first = [("income_actual", head, head, dt.date(1997, 1, 3), 100.0), ("income_actual", head, head, dt.date(1997, 2, 3), 50.0)]
    more, gone = [("income_actual", head, head, dt.date(1997, 1, 3), 11.0)], first[1:]
    inp = Booked(terms=of([]), tables={}, rules=TB.rules(spark), lines=TB.report_lines(spark), columns=TB.report_columns(spark, 1997), usd_rate=85.0)
    at, delta = str(tmp_path / "state"), INC.signed_sums(of(more), of(gone))
    monkeypatch.setattr(INC, "merged", lambda sums: pytest.fail("merged"))
    INC.build(replace(inp, book=of(first)), at)
    got = rows(INC.apply(inp, at, delta))
    assert got == rows(RP.full_report(replace(inp, book=of(first[:1] + more)))) and got
