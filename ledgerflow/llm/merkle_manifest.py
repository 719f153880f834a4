"""Merkle dataset manifest: a hash tree over all rows, its proofs, and what tampering breaks.

A row's leaf is H (lower-case hex sha256) of doc_id, source, lang, n_chars and text, each
``-`` if null, else its number of UTF-8 bytes, ``:`` and the value. Each source is a tree of
its leaves in ascending doc_id order, every ``FAN`` neighbours under one parent, until one
node remains; the sources' roots, in the order of the sources, form the upper tree.

Aligned blocks of ``FAN ** DEPTH`` leaves are the unit of work. A block keeps each of its
levels as one hex string: fixed-width substrings of it are hashed to the parents, and what
flanks a node's substring within its run are the siblings of a proof. Block roots are the
leaves of the next round of blocks, until each tree is one block: the number of rounds
grows with the logarithm of the rows. No source is in one task: rows are put in order by
ranges of (source, doc_id, leaf), and a row's place in its source is the number of rows in
earlier ranges and its place in its range.

Rows of one doc_id follow each other in the order of their leaves (equal rows have equal
leaves), a null doc_id comes first, a null source is a source of its own, before all others. An
empty table gives no rows. Other columns are ignored. A text of any length is hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.llm.common import id_crc32, stored

#: Children of a node, levels of a block, digits of a hash.
FAN, DEPTH, HEX = 3, 6, 64
BLOCK = FAN ** DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A value as the leaf holds it."""
    own = value.cast("string")
    return F.when(own.isNull(), "-").otherwise(F.concat(F.octet_length(own).cast("string"), F.lit(":"), own))


def leaf(text: Column) -> Column:
    """The leaf of a row whose text is ``text``."""
    return F.sha2(F.concat(*(field(text if c == "text" else F.col(c)) for c in FIELDS)), 256)


def without_line_breaks() -> Column:
    """The text as it is after tampering: every second row by crc32 of its id loses its
    line breaks. Null where a row is left as it is."""
    return F.when(F.pmod(id_crc32(), F.lit(2)) == 0, F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit("")))


def in_order(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``place`` (from 0) in their group and its ``total``, nulls first. The ranges
    are written down, so that a lost task can't deal them anew."""
    keys = [F.col(c).asc_nulls_first() for c in (group, *order, "uid")]
    rows = stored(rows.withColumn("uid", F.monotonically_increasing_id()), f"{name}-rows")
    # the id counts the rows of a task in their order, above it stands the task's number
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("uid").withColumn("at", F.monotonically_increasing_id())
    dealt = stored(dealt, f"{name}-ranges").withColumn("range", F.shiftright("at", 33))
    parts = dealt.groupBy(group, "range").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(group, "range", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
                         F.sum("n").over(Window.partitionBy(group)).alias("total"))
    return dealt.join(parts, [group, "range"]).withColumn("place", F.col("at") + F.col("shift")).drop("at", "range", "shift")


def _parents(level: Column) -> Column:
    """The next level's hex string: each run of ``FAN`` nodes, the last may be shorter, is hashed."""
    runs = F.floor((F.octet_length(level) / HEX + FAN - 1) / FAN)
    hashed = F.transform(F.sequence(F.lit(0).cast("long"), runs - 1), lambda k: F.sha2(F.substring(level, (k * FAN * HEX + 1).cast("int"), F.lit(FAN * HEX)), 256))
    return F.array_join(hashed, "").cast("binary")


def blocks(nodes: DataFrame, step: int) -> DataFrame:
    """One row per block of ``nodes`` (grp, total, place, node, other columns): its rows in order,
    its levels (bytes of the hex digits, cut at no cost), its root ``top``. A tree of one
    node has no parent, so a level that the whole tree doesn't have repeats the one below."""
    own = [c for c in nodes.columns if c not in ("grp", "total")]
    held = F.array_sort(F.collect_list(F.struct("place", *(c for c in own if c != "place"))))
    out = nodes.groupBy("grp", "total", F.floor(F.col("place") / BLOCK).alias("block")).agg(held.alias("rows"))
    out = out.withColumn("level_0", F.array_join(F.transform("rows", lambda r: r["node"]), "").cast("binary"))
    for k in range(DEPTH):
        level = F.col(f"level_{k}")
        out = out.withColumn(f"level_{k + 1}", F.when(F.col("total") > FAN ** (DEPTH * step + k), _parents(level)).otherwise(level))
    return out.withColumn("top", F.col(f"level_{DEPTH}").cast("string")).drop(f"level_{DEPTH}")


def grown(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The written blocks of each round, from the leaves to one block per tree."""
    rounds = []
    while True:
        rounds.append(stored(blocks(nodes, len(rounds)), f"{name}-blocks-{len(rounds)}"))
        if not rounds[-1].agg(F.max("block")).first()[0]:
            return rounds
        nodes = rounds[-1].select("grp", "total", F.col("block").alias("place"), F.col("top").alias("node"))


def _siblings(step: int) -> Column:
    """The segments left and right of node ``i`` of a block, by level; null where the tree has
    no such level."""
    def cut(level: Column, first: Column, n: Column) -> Column:
        return F.substring(level, (first * HEX + 1).cast("int"), (n * HEX).cast("int")).cast("string")

    out = []
    for k in range(DEPTH):
        level, at = F.col(f"level_{k}"), F.floor(F.col("i") / FAN ** k)
        run = F.floor(at / FAN) * FAN
        pair = F.struct(cut(level, run, at - run).alias("left"), cut(level, at + 1, run + FAN - 1 - at).alias("right"))
        out.append(F.when(F.col("total") > FAN ** (DEPTH * step + k), pair))
    return F.array(*out)


def paths(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """Leaves (grp, row) with the path of segments from leaf to root. ``above``: grp, path,
    and columns to hand on, of each tree's root."""
    keep = [c for c in above.columns if c not in ("grp", "path")]
    found = above.withColumn("place", F.lit(0).cast("long"))
    for step, level in reversed(list(enumerate(rounds))):
        held = level.withColumnRenamed("block", "place").join(found, ["grp", "place"])
        nodes = held.select("grp", "total", "path", *keep, *(f"level_{k}" for k in range(DEPTH)), F.posexplode("rows").alias("i", "row"))
        nodes = nodes.select("grp", "row", *keep, F.concat(_siblings(step), "path").alias("path"))
        found = nodes.select("grp", F.col("row.place").alias("place"), "path", *keep) if step else nodes
    return found


def folded(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path."""
    return F.aggregate(path, start, lambda node, p: F.when(p.isNull(), node).otherwise(F.sha2(F.concat(p["left"], node, p["right"]), 256)))


def segments(path: Column) -> Column:
    """All siblings of a path in one string, level by level, left to right (levels that the
    tree doesn't have leave nothing)."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")


def manifest(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """Per row: doc_id, leaf, subroot of its source, root, and path, an array of the sibling
    segments (left, right) from leaf to root, null for a level the tree doesn't have. ``changed`` is the text as it may have been
    tampered with, null where it wasn't: its leaf is ``changed_leaf``."""
    changed = F.lit(None).cast("string") if changed is None else changed
    source = F.col("source").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source)).alias("grp"),
                       leaf(F.col("text")).alias("node"), F.when(changed.isNotNull(), leaf(changed)).alias("changed"))
    rounds = grown(in_order(rows, "grp", ["doc_id", "node"], "merkle"), "merkle")
    roots = rounds[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("top").alias("node"))
    upper = grown(in_order(roots, "grp", ["name"], "merkle-top"), "merkle-top")
    root = upper[-1].select("grp", F.col("top").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    above = paths(upper, root).select(F.col("row.name").alias("grp"), F.col("row.node").alias("subroot"), "root", "path")
    found = paths(rounds, above)
    return found.select("row.doc_id", F.col("row.node").alias("leaf"), "subroot", "root", "path", F.col("row.changed").alias("changed_leaf"))


def verified(docs: DataFrame) -> DataFrame:
    """The manifest's digests per row, and whether each row, some of them tampered with, still
    leads to the root."""
    out = manifest(docs, without_line_breaks())
    out = out.withColumn("folded_root", folded(F.coalesce("changed_leaf", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(segments(F.col("path")), 256).alias("proof_sha256"), "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))
