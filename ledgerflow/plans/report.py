"""The cash-flow report as one Spark plan (Q1-Q3), and the report-side
queries Q8 (revised realisation dates), Q11 (buyer list) and Q17 (buyer
lookup).
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions import periods as P
from ..functions import scalars as S
from ..operators import balances as B
from ..operators import forecast as FC
from ..operators import rollup as R
from ..operators import rules as RU
from ..sources import domain
from ..sources import tables as TB
from ..session import materialize


@dataclass
class ReportInputs:
    """Every table the report reads, as DataFrames. ``pruned`` cuts the ledgers and
    receipts to the columns' span, for columns that cover a part of the data."""
    terms: DataFrame
    tables: dict[str, DataFrame]
    rules: DataFrame
    lines: DataFrame
    columns: DataFrame
    usd_rate: object = fixed.DEFAULT_SETTINGS["usd_rate"]     # number or scalar Column
    pruned: bool = False
    members: DataFrame | None = None                          # roll-up members of the folder, else the built-in lists
    terms_rows: int | None = None                             # about how many terms; unknown: counted as the report is planned

    def projected_income(self, prune: bool) -> DataFrame:
        """Weekly shipment receipts and weekly open-bill receipts."""
        forecast, bills = self.tables["shipment_forecast"], self.tables["bills_under_collection"]
        if prune:
            forecast, bills = _receipts_in_reach(self.terms, forecast, bills, RU.column_span(self.columns))
        return FC.projected_income(
            FC.shipment_forecast_weekly(FC.active_shipment_forecast(forecast, self.terms, self.terms_rows)),
            FC.bills_forecast_weekly(FC.bills_view(bills, self.terms, self.terms_rows)))

    def sources(self, prune: bool | None = None, only: set[str] | None = None) -> DataFrame:
        """All ledgers as one long frame, or ``only`` some of them."""
        prune = self.pruned if prune is None else prune
        window = RU.column_span(self.columns) if prune else None
        made = {**{name: lambda name=name: RU.ledger_view(self.tables[name], name, window=window)
                   for name in ("income_forecast", "income_actual", "expenses_forecast", "expenses_actual")},
                "shipments": lambda: RU.shipment_views(self.tables["shipments"], window),
                "final_proj_income": lambda: RU.projected_income_view(self.projected_income(prune), window)}
        views = [make() for name, make in made.items() if only is None or any(s.startswith(name) for s in only)]
        return reduce(DataFrame.unionByName, views) if views else RU.ledger_view(self.tables["income_actual"].limit(0), "none")


def inputs_from_dir(spark: SparkSession, sf_dir: str, year: int | None = None) -> ReportInputs:
    """Report inputs of a data folder: its own planning and configuration tables,
    or the driver tables through the domain views of sources.fixtures."""
    return inputs_from_tables(spark, domain.load(spark, sf_dir), domain.load_config(spark, sf_dir), year)


def inputs_from_tables(spark: SparkSession, t: dict[str, DataFrame], config: dict[str, DataFrame],
                       year: int | None = None) -> ReportInputs:
    """Report inputs from the domain tables (``sources.domain.load``) and the
    configuration (``load_config``). ``year`` keeps that year's columns only."""
    columns = config["report_columns"]
    if year is not None:
        columns = columns.where(F.year("date1") == year)
    terms = FC.buyer_terms(t["buyers"], t["bank_ratio"])
    return ReportInputs(
        terms=terms, terms_rows=terms.count(), tables=t, rules=config["rules"], lines=config["report_lines"],
        columns=columns, usd_rate=TB.setting(spark, "usd_rate", config["settings"]), pruned=year is not None,
        members=config.get("roll_up_members"))


def _receipts_in_reach(terms: DataFrame, forecast: DataFrame, bills: DataFrame, span):
    """Forecast lines and bills whose receipt week can fall inside ``span``.

    A receipt lands in week ``week_end(r)`` with ``r <= week_end(r) <= r + 6``,
    and ``r = ex-factory date + credit days`` (between the buyers' minimum and
    maximum) unless a revised date is set. So only ex-factory dates in
    ``[lo - 6 - max_days, hi - min_days]`` (or a revised date in ``[lo - 6, hi]``)
    can matter. The filter is a superset of what the report keeps; the exact
    window is applied to the weekly sums. The bounds are scalar subqueries over
    the columns and the buyers, so nothing runs while the plan is built."""
    lo, hi = span
    days = terms.agg(F.min("realised_day").alias("a"), F.max("realised_day").alias("b"))
    ex_lo = F.date_sub(lo, F.lit(6) + F.coalesce(days.select("b").scalar(), F.lit(0)).cast("int"))
    ex_hi = F.date_sub(hi, F.coalesce(days.select("a").scalar(), F.lit(0)).cast("int"))
    f_day = P.to_day("exfty_date", forecast.schema["exfty_date"].dataType)
    forecast = forecast.where(f_day.between(ex_lo, ex_hi))
    revised = S.first_present(*[P.to_day(c, bills.schema[c].dataType) for c in ("ex3", "ex2", "ex1")])
    b_day = P.to_day("ex_fty_date", bills.schema["ex_fty_date"].dataType)
    bills = bills.where(revised.between(F.date_sub(lo, 6), hi)
                        | (revised.isNull() & b_day.between(ex_lo, ex_hi)))
    return forecast, bills


def base_cells(inp: ReportInputs) -> DataFrame:
    """Q1, lazy."""
    return RU.base_cells(inp.sources(), inp.rules, inp.lines, inp.columns, inp.usd_rate)


#: The line whose cells a revised realisation date moves.
REVISED_LINE = "USD Sales from build up account"


def cells_of_line(inp: ReportInputs, line_name: str) -> DataFrame:
    """Q1 of one report line: only the ledgers that its rules name are read. The names, of
    which there are as many as ledgers, come to the driver."""
    rules = inp.rules.where(F.trim("line_name") == line_name.strip())
    only = {r[0] for r in rules.select("source").distinct().collect()}
    return RU.base_cells(inp.sources(only=only), rules, inp.lines, inp.columns, inp.usd_rate)


def stored(inp: ReportInputs) -> tuple[ReportInputs, DataFrame]:
    """The step between Q1 and the passes that read its cells several times: the base
    cells and the columns are written (checkpointed) once."""
    inp = replace(inp, columns=materialize(inp.columns))
    return inp, materialize(base_cells(inp))


def totals(inp: ReportInputs, cells: DataFrame | None = None, mode: str = "repaired") -> DataFrame:
    """Q2: totals and closings over the base cells."""
    if cells is None:
        inp, cells = stored(inp)
    return R.totals_and_closings(cells, inp.lines, inp.columns, mode, mem=inp.members)


def openings(inp: ReportInputs, cells: DataFrame | None = None) -> DataFrame:
    """Q3 as written: openings from the cells after one base + totals pass."""
    if cells is None:
        inp, base = stored(inp)      # written once; the totals over it are cheap to redo
        cells = base.unionByName(totals(inp, base, "literal"))
    return B.opening_balances(cells, inp.lines, inp.columns)


def balances(inp: ReportInputs, cells: DataFrame | None = None,
             initial: DataFrame | None = None) -> DataFrame:
    """Repaired Q2+Q3 for the accounts: the clamped balance chain. The cells
    are checkpointed first: the weekly chain feeds both the weekly and the
    month columns, so the plan reads them more than once."""
    if cells is None:
        inp, cells = stored(inp)
    return B.balance_roll_forward(cells, inp.lines, inp.columns, initial)


def full_report(inp: ReportInputs, initial: DataFrame | None = None) -> DataFrame:
    """The whole report rebuilt -- base cells, the clamped balance chain
    (openings and closings), then the roll-up totals over both."""
    inp, base = stored(inp)
    chain = B.balance_roll_forward(base, inp.lines, inp.columns, initial)
    cells = materialize(base.unionByName(chain))   # every roll-up level reads it again
    return cells.unionByName(totals_over_chain(inp, cells, inp.columns))


def totals_over_chain(inp: ReportInputs, cells: DataFrame, columns: DataFrame) -> DataFrame:
    """The roll-ups over cells that hold the chain's closings already."""
    mem = inp.members
    if mem is not None:
        mem = mem.where(~F.col("total_line").isin([fixed.LINE_ID_FORMAT % c for c, *_ in fixed.CLOSINGS]))
    return R.totals_and_closings(cells, inp.lines, columns, "repaired", closings=False, mem=mem)


# --- Q8 -------------------------------------------------------------------------------
def revised_date_impact(bills: DataFrame, cells: DataFrame,
                        line_name: str = REVISED_LINE,
                        window_days: int = fixed.OPENING_SHIFT_DAYS) -> DataFrame:
    """Q8: for every bill with a revised realisation date, the report cells of
    ``line_name`` whose date lies in the 7 days ending with the end of the
    revised date's week. The range join is turned into an equi join: each cell
    -- one line of the report -- stands for the 7 week ends that reach it, and a
    bill, of which there may be many, joins once by its week end."""
    revised = S.first_present(*[P.to_day(c, bills.schema[c].dataType) for c in ("ex3", "ex2", "ex1")])
    b = bills.select("invoice", revised.alias("revised_date")).where(F.col("revised_date").isNotNull())
    b = b.withColumn("week_end", P.week_end("revised_date"))
    c = cells.where(F.col("line_name") == line_name).select(
        "report_line", "report_col", "col_index", "ex_date", "line_name", "amount",
        F.explode(F.sequence("ex_date", F.date_add("ex_date", window_days - 1))).alias("week_end"))
    return b.join(c, "week_end").select(
        "invoice", "revised_date", "week_end", "report_line", "report_col", "col_index",
        "ex_date", "line_name", "amount")


# --- Q11, Q17 ----------------------------------------------------------------------------
def buyer_list(buyers: DataFrame) -> DataFrame:
    """Q11: name, buyer name and bank per buyer, with the total row (A10). None
    of the three is a number, so the total row has its label only."""
    rows = buyers.select("name", "buyer_name", "bank")
    none = F.lit(None).cast("string")
    total = buyers.sparkSession.range(1).select(
        F.lit("Total").alias("name"), none.alias("buyer_name"), none.alias("bank"))
    return rows.unionByName(total)


def forecast_totals(report: DataFrame) -> DataFrame:
    """A10 on the forecast report (Q9): quantity and amount by buyer, by bank over its buyers, and over
    all, exact. ``level`` tells a total row from a group whose key is null."""
    sums = report.groupBy("bank", "buyer").agg(S.money_sum("quantity").alias("quantity"), S.money_sum("amount").alias("amount"))
    rolled = sums.rollup("bank", "buyer").agg(F.grouping_id().alias("g"), *(F.sum(c).cast(S.MONEY).cast("double").alias(c) for c in ("quantity", "amount")))
    level = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "bank").otherwise("buyer")
    return rolled.select(level.alias("level"), "bank", "buyer", "quantity", "amount")


def buyer_lookup(buyers: DataFrame, name: str) -> DataFrame:
    """Q17: bank and name of the buyer called ``name`` (first by name, bank)."""
    return (buyers.where(F.col("buyer_name") == name).select("bank", "buyer_name")
            .orderBy("buyer_name", "bank").limit(1))
