"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import forget, stored


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(id, root) for every id of ``links`` (a, b) but the roots: the smallest id of its
    component. Alternating large-star and small-star steps until the links rest; every
    step is a minimum by node, which is combined before the shuffle, and a join, so a node
    with many links is no single task's. Each round is written to the shared folder, and
    the one before removed."""
    a, b = F.least("a", "b"), F.greatest("a", "b")
    links = stored(links.where("a <> b").select(a.alias("a"), b.alias("b")).distinct(), name)
    before = None
    while True:
        last, links = links, stored(small_star(large_star(links)), name)
        forget(last)
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            return links.select(F.col("b").alias("id"), F.col("a").alias("root"))
        before = now


def large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the smallest of the node and its neighbours."""
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    moved = both.where("b > a").join(least, "a").where("b <> least")
    return moved.select(F.col("least").alias("a"), "b").distinct()


def small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of these."""
    least = links.groupBy("b").agg(F.min("a").alias("least"))
    moved = links.join(least, "b").where("a <> least").select(F.col("least").alias("a"), F.col("a").alias("b"))
    return moved.unionAll(least.select(F.col("least").alias("a"), "b")).distinct()
