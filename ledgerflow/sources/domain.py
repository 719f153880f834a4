"""Load the domain tables of a data folder.

A folder holding the planning tables themselves (``shipment_forecast.parquet``,
``bills_under_collection.parquet``, ``buyers.parquet``, ``bank_ratio.parquet``,
the four ledgers, ``shipments.parquet``) is read as is. A folder of the
driver's star-schema test tables is presented through ``fixtures``.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.periods import to_day
from . import fixtures as fx
from . import tables as TB
from .tables import read_table

DOMAIN_TABLES = ["buyers", "bank_ratio", "shipment_forecast", "bills_under_collection",
                 "income_forecast", "income_actual", "expenses_forecast", "expenses_actual",
                 "shipments"]

_ADAPTERS = {
    "buyers": fx.buyers, "bank_ratio": fx.bank_ratio, "shipment_forecast": fx.shipment_forecast,
    "bills_under_collection": fx.bills_under_collection, "income_forecast": fx.income_forecast,
    "income_actual": fx.income_actual, "expenses_forecast": fx.expenses_forecast,
    "expenses_actual": fx.expenses_actual, "shipments": fx.shipments,
}


def has_domain_tables(data_dir: str) -> bool:
    """True for a local folder with the planning tables. (For remote storage
    pass ``domain=True`` to ``load`` instead.)"""
    return os.path.exists(os.path.join(data_dir, "shipment_forecast.parquet"))


#: Configuration that a folder may hold as tables; the built-in one serves where it doesn't.
CONFIG_TABLES = ["report_lines", "report_columns", "rules", "settings", "roll_up_members"]


def load_config(spark: SparkSession, data_dir: str) -> dict[str, DataFrame]:
    """Report lines, report columns, rules, settings and roll-up members of ``data_dir``. Without
    a columns table the columns cover all years of the data; without a members table
    there is no such entry, and the built-in lists serve."""
    found = {t: TB.optional_table(spark, data_dir, t) for t in CONFIG_TABLES}
    out = {t: df for t, df in found.items() if df is not None}
    for t, build in (("report_lines", TB.report_lines), ("rules", TB.rules), ("settings", TB.settings)):
        if t not in out:
            out[t] = build(spark)
    if "report_columns" not in out:
        years = fx.column_years(spark, data_dir) if not has_domain_tables(data_dir) else _years(load(spark, data_dir))
        out["report_columns"] = TB.report_columns_between(years)
    return out


def _years(t: dict[str, DataFrame]) -> DataFrame:
    """The years of the planning tables' own dates, and one more for the receipts."""
    dates = [("income_forecast", "expenses_date"), ("income_actual", "expenses_date"), ("expenses_forecast", "expenses_date"),
             ("expenses_actual", "expenses_date"), ("shipments", "shipment_date"), ("shipment_forecast", "exfty_date"),
             ("bills_under_collection", "ex_fty_date")]
    days = reduce(DataFrame.unionAll, [t[n].select(to_day(c, t[n].schema[c].dataType).alias("d")) for n, c in dates])
    return days.agg(F.year(F.min("d")).alias("first"), (F.year(F.max("d")) + 1).alias("last"))


def load(spark: SparkSession, data_dir: str, domain: bool | None = None) -> dict[str, DataFrame]:
    """All domain tables of ``data_dir`` as lazy DataFrames."""
    domain = has_domain_tables(data_dir) if domain is None else domain
    if domain:
        return {t: read_table(spark, data_dir, t) for t in DOMAIN_TABLES}
    return {t: f(spark, data_dir) for t, f in _ADAPTERS.items()}
