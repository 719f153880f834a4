"""Receipt forecasts: shipments and bills -> weekly receipts per account.

Q4: shipment forecast; Q5/Q6: bills under collection (open / realised);
Q7: fund flow; Q9/Q10: buyer-term joins; Q15: early variants; Q16: refresh.

Scale notes. The fact side (forecast lines, bills) is the only large input.
Joins to buyer terms are N:1 dimension joins (``joins.dimension_join``): Spark decides by
size and splits a hot buyer's partition while it runs; terms of very many buyers are
hashed, so the fact side is never sorted. The weekly
aggregation has a handful of groups per month, so the
partial (map-side) aggregate shrinks every task's output to a few rows before
the shuffle: a week holding a third of all rows costs no more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import periods as P
from ..functions import scalars as S
from .joins import dimension_join
from .reshape import long_to_wide

ACCOUNT_NAMES = [d for _, d in fixed.ACCOUNTS]


# Q16 / P2 ----------------------------------------------------------------------
def refresh_forecast_fields(sf: DataFrame, mode: str = "repaired") -> DataFrame:
    """Derive the working fields of a forecast line from the imported ones.
    An import fills ``fob_price`` and leaves ``fobpc`` empty; ``literal``
    overwrites the price with ``fobpc`` all the same, ``repaired`` keeps the
    imported price and quantity where the working ones are missing."""
    qty = S.number_of(sf, "po_qty")
    rate = S.number_of(sf, "fobpc")
    if mode == "repaired":
        qty = F.coalesce(qty, S.number_of(sf, "order_qty"))
        rate = F.coalesce(rate, S.number_of(sf, "fob_price"))
    return sf.withColumns({
        "ex_date": P.to_day("exfty_date", sf.schema["exfty_date"].dataType),
        "fob_price": rate, "rate": rate,
        "quantity": qty, "order_qty": qty,
        "total": S.line_amount(qty, rate),
        "original_shipment_date": F.col("oc"),
    })


# Q10 / J1 ----------------------------------------------------------------------
def buyer_terms(buyers: DataFrame, ratios: DataFrame) -> DataFrame:
    """Buyers with their bank's account ratios (inner join bank = name)."""
    r = ratios.select("name", *[S.number_of(ratios, c).alias(c) for c in fixed.RATIO_FIELDS])
    return dimension_join(buyers, r, ["bank"], ["name"])


# Q9 / J2, P14, P16 -------------------------------------------------------------
def shipment_forecast_report(sf: DataFrame, terms: DataFrame, terms_rows: int | None = None) -> DataFrame:
    """Forecast lines with the buyer's credit days and ratios; ``r_day`` is
    the ex-factory date moved by the buyer's credit period. ``terms_rows``: about how many
    terms there are, counted where not given."""
    f = refresh_forecast_fields(sf)
    t = terms.select("buyer_name", "bank", "realised_day", *fixed.RATIO_FIELDS)
    j = dimension_join(f, t, ["buyer"], ["buyer_name"], dim_rows=terms_rows)
    return j.select(
        "buyer", "style", "ex_date",
        P.shift_days("ex_date", "realised_day").alias("r_day"),
        "quantity", "rate", S.line_amount("quantity", "rate").alias("amount"),
        "buyer_name", "bank", *fixed.RATIO_FIELDS, "status",
        *(["considerable_handover"] if "considerable_handover" in sf.columns else []))


def active_shipment_forecast(sf: DataFrame, terms: DataFrame, terms_rows: int | None = None) -> DataFrame:
    """The forecast view: report rows of the current (Active) snapshot."""
    return shipment_forecast_report(sf, terms, terms_rows).where(F.col("status") == "Active")


# bills view -----------------------------------------------------------------------
def bills_view(bills: DataFrame, terms: DataFrame, terms_rows: int | None = None) -> DataFrame:
    """Bills with buyer ratios and the expected realisation day ``r_day``:
    the latest revised date (ex3, then ex2, then ex1), else the ex-factory
    date plus the buyer's credit days. A bill without an amount is valued
    at quantity x unit price."""
    b = bills
    t = terms.select("buyer_name", "realised_day", *fixed.RATIO_FIELDS)
    j = dimension_join(b, t, ["buyer"], ["buyer_name"], dim_rows=terms_rows)
    ex_fty = P.to_day("ex_fty_date", b.schema["ex_fty_date"].dataType)
    revised = S.first_present(*[P.to_day(c, b.schema[c].dataType) for c in ("ex3", "ex2", "ex1")])
    amount = F.coalesce(S.number_of(b, "total__fob_income"),
                        S.number_of(b, "qty_pcs") * S.number_of(b, "unit_price"))
    return j.select(
        "invoice", "buyer", ex_fty.alias("ex_fty_date"),
        F.coalesce(revised, P.shift_days(ex_fty, "realised_day")).alias("r_day"),
        amount.alias("total__fob_income"), *fixed.RATIO_FIELDS, "status")


def realised(status_col: str = "status"):
    """Status mentions REALIZED (any case). NULL status is neither."""
    return F.upper(F.col(status_col)).like("%REALIZED%")


# weekly split core (P13, P10/P11, A1, R2) ---------------------------------------------
def split_rows(df: DataFrame, amount, day, keep=(), share: bool = False) -> DataFrame:
    """Per row: week-of-month end of ``day`` and ``amount`` split over the
    five accounts (P13, P10, P11)."""
    return df.select(*keep, P.week_end(day).alias("weekend"),
                     *[S.ratio_split(amount, r, share).alias(r) for r in fixed.RATIO_FIELDS])


def split_by_week(df: DataFrame, amount, day, share: bool = False) -> DataFrame:
    """One row per week with the five exact split sums (NULL week kept as its
    own group)."""
    per_row = split_rows(df, amount, day, share=share)
    return per_row.groupBy("weekend").agg(
        *[S.money_sum(r).cast("double").alias(d) for r, d in fixed.ACCOUNTS])


def weekly_to_long(weekly: DataFrame, unit: str = "USD") -> DataFrame:
    """R2: five account columns -> rows ``(variable=week, Unit, Descriptio, value)``."""
    return (weekly.select(F.col("weekend").alias("variable"), F.lit(unit).alias("Unit"),
                          *[F.col(f"`{d}`") for d in ACCOUNT_NAMES])
            .unpivot(["variable", "Unit"], ACCOUNT_NAMES, "Descriptio", "value"))


# Q4 ----------------------------------------------------------------------------------
def shipment_rows(view: DataFrame, keep=()) -> DataFrame:
    """Per forecast row: net amount after bank charge, whole units."""
    price, qty = S.number_of(view, "rate"), S.number_of(view, "quantity")
    return view.select(*keep, S.net_shipment_amount(price, qty).alias("amount"), "r_day",
                       *fixed.RATIO_FIELDS)


def bill_rows(view: DataFrame, keep=()) -> DataFrame:
    """Per bill: amount net of the bank charge."""
    return view.select(*keep, S.net_bill_amount(S.number_of(view, "total__fob_income")).alias("amount"),
                       "r_day", *fixed.RATIO_FIELDS)


def shipment_forecast_weekly(view: DataFrame, from_date=None) -> DataFrame:
    """Weekly receipts from the forecast view: net amount after bank charge
    (rounded to whole units), bucketed by week of ``r_day``, split over the
    five accounts, summed, long. ``from_date`` (a Column or literal date) keeps
    only rows with ``r_day >= from_date`` (F6)."""
    v = view if from_date is None else view.where(F.col("r_day") >= from_date)
    return weekly_to_long(split_by_week(shipment_rows(v), "amount", "r_day"))


# Q5 / Q6 ----------------------------------------------------------------------------
def _bills_weekly(view: DataFrame) -> DataFrame:
    return weekly_to_long(split_by_week(bill_rows(view), "amount", "r_day"))


def bills_forecast_weekly(view: DataFrame) -> DataFrame:
    """Q5: bills not yet realised (NULL status drops out, as in SQL)."""
    return _bills_weekly(view.where(~realised()))


def bills_actual_weekly(view: DataFrame) -> DataFrame:
    """Q6: realised bills."""
    return _bills_weekly(view.where(realised()))


# final_proj_income ----------------------------------------------------------------
def projected_income(*longs: DataFrame) -> DataFrame:
    """All projected income rows ``(Descriptio, variable, value)``."""
    out = None
    for df in longs:
        part = df.select("Descriptio", "variable", "value")
        out = part if out is None else out.unionByName(part)
    return out


# Q7 / R3 x2, J7 --------------------------------------------------------------------
def fund_flow(shipment_long: DataFrame, bills_long: DataFrame) -> DataFrame:
    """Weekly shipment receipts next to weekly bill receipts: each side
    pivoted to one column per account (``_x`` shipments, ``_y`` bills) and
    full-outer joined on the week."""
    a = long_to_wide(shipment_long, "variable", "Descriptio", "value", ACCOUNT_NAMES, "_x")
    b = long_to_wide(bills_long, "variable", "Descriptio", "value", ACCOUNT_NAMES, "_y")
    return a.join(b, "variable", "full")


# Q15 ----------------------------------------------------------------------------------
def early_weekly_split(view: DataFrame, amount_col: str, day_col: str,
                       exclude_handover: str | None = "BUC") -> DataFrame:
    """The first form of the split: whole rows with any null dropped, the gross
    amount (no bank charge), weeks keyed as text, wide output with one column
    per ratio field. Rows handed over as ``exclude_handover`` are left out when
    the view carries ``considerable_handover``."""
    v = view
    if exclude_handover is not None and "considerable_handover" in v.columns:
        v = v.where(F.col("considerable_handover") != exclude_handover)
    v = S.drop_any_null(v)
    per_row = v.select(S.date_key(P.week_end(P.to_day(day_col, v.schema[day_col].dataType))).alias("w"),
                       *[S.ratio_split(S.number_of(v, amount_col), r).alias(r)
                         for r in fixed.RATIO_FIELDS])
    return per_row.groupBy("w").agg(*[S.money_sum(r).cast("double").alias(r)
                                      for r in fixed.RATIO_FIELDS])


def bills_early_view(view: DataFrame) -> DataFrame:
    """The early bills view: realisation day, gross total and amount."""
    return view.select("invoice", "buyer", "ex_fty_date", F.col("r_day").alias("realised_day"),
                       F.col("total__fob_income").alias("total"),
                       F.col("total__fob_income").alias("amount"), *fixed.RATIO_FIELDS, "status")
