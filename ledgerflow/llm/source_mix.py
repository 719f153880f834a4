"""Mixing sources to target weights with a low-discrepancy schedule.

A source's documents are shuffled (by a hash of doc_id and a seed), laid end to end
and cut into blocks of ``BLOCK`` words. The mix is a sequence of slots, one block
each: slot t takes the point t * MULTIPLIER mod 2^31 (a golden-ratio sequence in whole
numbers), and the point falls into one source's stretch of the cumulative targets.
Slots are ranked per source; rank r takes block r mod blocks in epoch r div blocks, so
every prefix of the mix is near the weights. No document is taken more than
``MAX_EPOCHS`` times.

Targets: sources in code point order, null last, have the weights 5, 2, 1, repeating,
and share the words of all sources; a target stops at ``MAX_EPOCHS`` times its source's
words and the excess is shared by weight among the rest.

Nothing is ordered or ranked over a whole source: running sums and ranks are taken
inside (source, hash bucket) and (source, run of slots), and the totals of those, few
rows, are added up.

Words are ``[^\\x20\\x09-\\x0D]+``; null and empty texts have size 0 and take nothing. A
null source is a source of its own, a null doc_id a value like any other. Rows that
share a doc_id are laid in the order of a hash of their texts. An empty table, or one without words,
takes nothing. Equal rows are interchangeable. Other columns pass ``mix_documents`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.llm.common import stored, tidy

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Words in a block: a source's taken words are within a few blocks of its target.
BLOCK = 32
#: 2^31 over the golden ratio, made odd: point t is t * MULTIPLIER mod 2^31.
POINTS, MULTIPLIER = 2**31, 1327217885
#: Cells of the points by which slots find their source's stretch.
CELL_POINTS = 2**19
#: Slots that are ranked together, by source.
RUN = 1 << 14
#: Sources whose stretches every task gets; with more, slots and stretches are dealt by cell.
SENT_SOURCES = 100_000
#: Leading hex digits of the shuffle's hash that make a bucket.
BUCKET_DIGITS = 3
SEED = "mix-1"
WORD_COUNT = r"regexp_count(coalesce(cast({0} as string), ''), '[^\\x20\\x09-\\x0D]+')"
ALL = (Window.unboundedPreceding, Window.unboundedFollowing)


def laid_out(docs: DataFrame) -> DataFrame:
    """``docs`` with __source, __size (words) and the shuffle's __place, a hash of the id and the
    text, so rows of one id, or of none, lie anywhere in their source."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    seeded = F.concat_ws("|", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text.cast("binary")))
    return docs.withColumns({
        "__source": F.col("source").cast("string"), "__size": F.expr(WORD_COUNT.format("text")).cast("long"), "__place": F.md5(seeded)})


def _by_name():
    """Sources in code point order, null last: one row for each."""
    return Window.orderBy(F.col("__source").asc_nulls_last())


def targets(sized: DataFrame) -> DataFrame:
    """One row per source: __source, source_size, weight, target. Sources in the order
    of stop / weight are stopped as long as the level of those left is above; the
    windows hold one row per source."""
    per = sized.groupBy("__source").agg(F.sum("__size").alias("source_size"))
    turn = (F.row_number().over(_by_name()) - 1) % len(WEIGHTS) + 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), turn.cast("int")))
    stop = F.col("source_size") * MAX_EPOCHS
    fill = Window.orderBy(stop / F.col("weight"), F.col("__source").asc_nulls_last())
    stopped = F.coalesce(F.sum(stop).over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (F.sum("source_size").over(fill.rowsBetween(*ALL)) - stopped) / left)
    free = F.when(F.col("weight") * F.col("level") <= stop, F.struct(stop / F.col("weight"), "level"))
    per = per.withColumn("shared", F.min(free).over(fill.rowsBetween(*ALL))["level"])
    target = F.least(F.col("weight") * F.coalesce("shared", F.lit(0.0)), stop.cast("double"))
    return per.select("__source", "source_size", "weight", target.alias("target"))


def stretches(per_source: DataFrame) -> DataFrame:
    """Targets with the source's stretch [lo, hi) of the points, its blocks, and the
    slots of the whole mix."""
    upto = F.sum("target").over(_by_name().rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("target").over(_by_name().rowsBetween(*ALL))
    hi = F.when(total > 0, F.floor(upto / total * POINTS + 0.5)).otherwise(0).cast("long")
    out = per_source.withColumns({"hi": hi, "source_no": F.row_number().over(_by_name()), "slots": F.ceil(total / BLOCK).cast("long")})
    return out.withColumns({"lo": F.coalesce(F.lag("hi").over(_by_name()), F.lit(0).cast("long")),
                            "blocks": F.expr(f"(source_size + {BLOCK - 1}) div {BLOCK}")})


def schedule(plan: DataFrame) -> DataFrame:
    """The mix: slot, source_no, epoch, block, in any order of rows. Spark takes the slots for as few bytes as the
    runs they are made of, so the joins say which side is small: else all slots may be gathered in the driver."""
    # few rows that become many: a given number of partitions is not merged into fewer
    tasks = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = plan.agg(F.max("slots").alias("slots")).where("slots > 0").select(
        "slots", F.explode(F.expr(f"sequence(0L, (slots - 1) div {RUN})")).alias("run")).repartition(tasks, "run")
    slots = runs.select("run", F.explode(F.expr(f"sequence(run * {RUN}, least((run + 1) * {RUN}, slots) - 1)")).alias("slot"))
    slots = slots.withColumn("point", F.expr(f"((slot % {POINTS}) * {MULTIPLIER}) % {POINTS}"))
    slots = slots.withColumn("cell", F.expr(f"point div {CELL_POINTS}"))
    cells = plan.where("hi > lo").select(
        "source_no", "lo", "hi", F.explode(F.expr(f"sequence(lo div {CELL_POINTS}, (hi - 1) div {CELL_POINTS})")).alias("cell"))
    with tidy(plan.sparkSession):
        few = plan.count() <= SENT_SOURCES
    dealt = slots.join(F.broadcast(cells) if few else cells.hint("merge"), "cell").where("lo <= point and point < hi").select("run", "slot", "source_no")
    in_run = F.row_number().over(Window.partitionBy("run", "source_no").orderBy("slot")) - 1
    ranked = dealt.withColumn("in_run", in_run)
    counts = dealt.groupBy("run", "source_no").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("source_no").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("run", "source_no", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    ranked = ranked.join(counts.hint("merge"), ["run", "source_no"]).withColumn("rank", F.col("earlier") + F.col("in_run"))
    ranked = ranked.join(plan.select("source_no", "blocks"), "source_no")
    return ranked.where(f"rank < {MAX_EPOCHS} * blocks").select(
        "slot", "source_no", F.expr("rank div blocks").alias("epoch"), F.expr("rank % blocks").alias("block"))


def placed(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """``sized`` with source_no and __begin, the words before the row in its source."""
    named = sized.withColumn("__bucket", F.substring("__place", 1, BUCKET_DIGITS))
    order = Window.partitionBy("__source", "__bucket").orderBy("__place", "doc_id", "__uid")
    named = named.withColumn("__in_bucket", F.sum("__size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__size"))
    totals = sized.groupBy("__source", F.substring("__place", 1, BUCKET_DIGITS).alias("__bucket")).agg(F.sum("__size").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(F.col("__source").alias("s"), F.col("__bucket").alias("b"), F.coalesce(earlier, F.lit(0)).alias("__before"))
    totals = totals.join(plan.select(F.col("__source").alias("p"), "source_no", "source_size", "target"), F.col("s").eqNullSafe(F.col("p"))).drop("p")
    out = named.join(totals, F.col("__source").eqNullSafe(F.col("s")) & (F.col("__bucket") == F.col("b")))
    return out.withColumn("__begin", F.col("__before") + F.col("__in_bucket")).drop("s", "b", "__in_bucket", "__before")


def doc_blocks(rows: DataFrame) -> DataFrame:
    """(source_no, block, __begin, words): the blocks that each row's words lie in. They are many more than the rows,
    which Spark doesn't see: a join with them must not send them to every task."""
    cut = rows.where("__size > 0").select("source_no", "__begin", "__size", F.explode(F.expr(
        f"sequence(__begin div {BLOCK}, (__begin + __size - 1) div {BLOCK})")).alias("block"))
    words = F.expr(f"least((block + 1) * {BLOCK}, __begin + __size) - greatest(block * {BLOCK}, __begin)")
    return cut.select("source_no", "block", "__begin", words.alias("words")).hint("merge")


def taken_words(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken."""
    sized = stored(laid_out(docs.select("doc_id", "source", "text")).select(
        "doc_id", "__source", "__size", "__place", F.monotonically_increasing_id().alias("__uid")), "mix-sizes")
    plan = stored(stretches(targets(sized)), "mix-plan")
    rows = placed(sized, plan)
    times = schedule(plan).groupBy("source_no", "block").agg(F.count("*").alias("times"))
    taken = doc_blocks(rows).join(times, ["source_no", "block"]).groupBy("source_no", "__begin").agg(
        F.sum(F.col("words") * F.col("times")).alias("taken"))
    # __begin names a row among those with words
    out = rows.join(taken.withColumnRenamed("__begin", "at").withColumnRenamed("source_no", "of"),
                    (F.col("source_no") == F.col("of")) & (F.col("__begin") == F.col("at")) & (F.col("__size") > 0), "left")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__size").alias("size"), "source_size", "target",
                      F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: one row per document and epoch that took words of it, its
    text cut to the words taken (words joined by blanks where it is cut), all columns of
    ``docs``. ``n_chars`` follows the text. Rows come in no order: who wants that of the
    schedule sorts by slot (``schedule``).

    The rows are numbered and written first. Only numbers, sizes and places go through the
    schedule; the texts meet what is taken of them once, one row each, and epochs are made
    of them there."""
    columns, schema = docs.columns, docs.schema
    held = stored(docs.select(F.struct(*columns).alias("__row"), F.monotonically_increasing_id().alias("__uid")), "mix-rows")
    own = held.select("__uid", *(F.col("__row")[c].alias(c) for c in ("doc_id", "source", "text")))
    sized = stored(laid_out(own).select("__uid", "doc_id", "__source", "__size", "__place"), "mix-sizes")
    plan = stored(stretches(targets(sized)), "mix-plan")
    rows = placed(sized, plan).where("__size > 0")
    taken = doc_blocks(rows.select("source_no", "__begin", "__size")).join(
        schedule(plan), ["source_no", "block"]).groupBy("source_no", "__begin", "epoch").agg(F.sum("words").alias("__taken"))
    taken = rows.select("source_no", "__begin", "__uid", "__size").join(taken, ["source_no", "__begin"])
    taken = taken.groupBy("__uid", "__size").agg(F.collect_list("__taken").alias("__epochs"))  # MAX_EPOCHS at most
    out = held.join(taken, "__uid").select("__row", "__size", F.explode("__epochs").alias("__taken"))
    text = F.col("__row")["text"].cast("string")
    first_words = F.concat_ws(" ", F.slice(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), 1, F.col("__taken").cast("int")))
    out = out.withColumn("__text", F.when(F.col("__taken") >= F.col("__size"), text).otherwise(first_words))
    new = {"text": F.col("__text"), "n_chars": F.char_length("__text")}
    return out.select(*(new[c].cast(schema[c].dataType).alias(c) if c in new else F.col("__row")[c].alias(c) for c in columns))
