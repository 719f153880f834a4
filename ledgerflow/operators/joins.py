"""Fact-to-dimension (N:1) joins.

A small dimension carries no hint: Spark broadcasts it when its statistics,
or at run time its shuffled size, are under the session's threshold, and splits
a hot key's partition otherwise (adaptive skew join). ``buckets`` asks for a
salted join instead, for sessions without adaptive execution: fact rows get a
salt in turn -- by row, so equal rows of a hot key are spread, too -- and the
dimension is repeated once for each salt.

A dimension of more than ``HASHED_FROM`` rows, too large for a broadcast, is hashed by
partitions and the fact rows stream by: no task sorts its share of the facts, of which there
are most, so what it holds doesn't grow with them. Where the session's partitions would get
more than ``ROWS_OF_A_TASK`` of the dimension each, both sides are dealt in more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HASHED_FROM = 100_000
ROWS_OF_A_TASK = 500_000


def dimension_join(fact: DataFrame, dim: DataFrame, fact_keys: Sequence[str],
                   dim_keys: Sequence[str], how: str = "inner", buckets: int = 0,
                   dim_rows: int | None = None) -> DataFrame:
    """``fact`` joined to ``dim`` on ``fact_keys == dim_keys`` (dim keys unique).
    Output: all fact columns and all dim columns (names must not clash).
    ``dim_rows``: about how many rows the dimension has, counted where not given."""
    if buckets <= 1:
        fact, dim = _hashed(fact, dim, fact_keys, dim_keys, dim_rows)
        return fact.join(dim, [fact[f] == dim[d] for f, d in zip(fact_keys, dim_keys)], how)
    f = fact.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(buckets)).cast("int"))
    d = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    cond = [f[a] == d[b] for a, b in zip(fact_keys, dim_keys)] + [f["_salt"] == d["_salt"]]
    return f.join(d, cond, how).drop(f["_salt"]).drop(d["_salt"])


def _hashed(fact: DataFrame, dim: DataFrame, fact_keys: Sequence[str], dim_keys: Sequence[str],
            dim_rows: int | None) -> tuple[DataFrame, DataFrame]:
    """Both sides, dealt and hinted by the dimension's rows; as they are where it is small."""
    if dim_rows is None:
        dim_rows = dim.count()
    if dim_rows <= HASHED_FROM:
        return fact, dim
    parts = -(-dim_rows // ROWS_OF_A_TASK)
    if parts > int(fact.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        fact, dim = fact.repartition(parts, *fact_keys), dim.repartition(parts, *dim_keys)
    return fact, dim.hint("shuffle_hash")
