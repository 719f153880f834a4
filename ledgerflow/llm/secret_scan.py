"""Secret scans: patterns, and a battery of randomness tests with a false-discovery bound.

Three patterns give the base spans: assignments to a name of a secret, access key ids, and
hexadecimal runs. Beside them, every run of ``LEAST`` or more letters, digits and ``+/_-``
is tested: does it look like evenly drawn symbols? Its encoding is the first alphabet
of ``ALPHABETS`` that has all its symbols; on the symbols' places in it three tests are made,

* chi-squared: are all symbols of the alphabet equally common;
* runs: do the upper and the lower half of the alphabet alternate as often as by chance;
* serial correlation: does a symbol depend on the one before it;

and their scores, each about normal for an evenly drawn run, are added up (Stouffer). A
small sum means random.

Long words pass for random the more easily the shorter they are. So each run is
compared with ``DECOYS`` strings of its own length made of ordinary letters of its own document.
Over the whole corpus, the bar of each class of lengths and each size of alphabet is the highest
score up to which the expected number of ordinary runs is at most ``RATE`` of the runs
found: the share of the class's decoys that are of this alphabet and have such a score, times the
class's runs. It is ``REJECT`` at most, where a run stops to look random. A document too
short for decoys borrows those of its class.

Spans are in code points, their end is exclusive. The tests add a span ``random`` where no
base span holds it. Everything is DataFrame expressions.

Null and empty texts have no spans; rows that share a doc_id are told apart; an empty table gives no
rows. Other columns are ignored. A text of any length is scanned whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.llm.common import stored

#: The base kinds in their order, with pattern and the group and length that count.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)(?-i)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = [("assign", ASSIGN, 2, 12), ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]+", 0, 16)]
#: The battery's kind, listed after them.
RANDOM = "random"
#: Symbols of the shortest run that is tested.
LEAST = 20
#: Alphabets in the order in which they are tried. ``-`` and ``_`` are read as ``+`` and ``/``.
ALPHABETS = [
    "0123456789abcdef",
    "0123456789ABCDEF",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "abcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
]
#: Lengths at which a class begins.
CLASSES = [20, 24, 32, 48, 64, 128]
DECOYS = 20
RATE = 0.05
#: Scores are counted in steps of 1 / STEPS from LOWEST to HIGHEST; REJECT is the highest for a random run.
STEPS, LOWEST, HIGHEST, REJECT = 4, -20, 80, 9
#: Mean and deviation of the absolute value of a normal variable.
HALF_MEAN, HALF_DEV = math.sqrt(2 / math.pi), math.sqrt(1 - 2 / math.pi)

MARK = "array<struct<kind:int,i:int,gap:int,size:int,text:string>>"


def _marks(text: str, kind: int, pattern: str, quick: str, group: int, least: int) -> tuple[dict[str, Column], Column]:
    """Helper columns, and the array of a pattern's matches: number, distance from the match before,
    size, and whether it counts. ``quick`` must be in the text for there to be any."""
    some = F.col(text).rlike(quick)
    none = F.array().cast("array<string>")
    columns = {f"held_{kind}": F.when(some, F.regexp_extract_all(text, F.lit(pattern), 0)).otherwise(none),
               f"rest_{kind}": F.when(some, F.split(text, pattern, -1)).otherwise(none)}
    own = F.col(f"held_{kind}")
    if group:
        columns[f"part_{kind}"] = F.when(some, F.regexp_extract_all(text, F.lit(pattern), group)).otherwise(none)
        own = F.col(f"part_{kind}")
    counts = lambda m, i: F.char_length(F.get(own, i) if group else m) >= least
    found = F.transform(f"held_{kind}", lambda m, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), F.char_length(F.get(F.col(f"rest_{kind}"), i)).alias("gap"), F.char_length(m).alias("size"),
        F.when(counts(m, i), m).alias("text")))
    return columns, found


def _alphabet(own: Column) -> Column:
    out = F.lit(None).cast("string")
    for symbols in reversed(ALPHABETS):
        out = F.when(F.translate(own, symbols, "") == "", symbols).otherwise(out)
    return out


def battery(rows: DataFrame, text: str, out: str) -> DataFrame:
    """``rows`` with ``out``, the score of the run in column ``text`` (about 0 for a random one,
    larger for others), in steps, and ``symbols``, the size of its alphabet; null for null."""
    own = F.translate(F.rtrim(F.col(text), F.lit("=")), "-_", "+/")
    rows = rows.withColumn("_own", own).withColumn("_alphabet", _alphabet(F.col("_own"))).withColumn("_n", F.char_length("_own").cast("double"))
    size = F.char_length("_alphabet").cast("double")
    each = F.transform(F.split("_alphabet", ""), lambda a: F.char_length("_own") - F.char_length(F.replace(F.col("_own"), a, F.lit(""))))
    squares = F.aggregate(each, F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    values = F.transform(F.split("_own", ""), lambda c: F.call_function("instr", F.col("_alphabet"), c) - 1)
    rows = rows.withColumns({"_size": size, "_squares": squares, "_values": values})
    half = F.col("_size") / 2
    start = F.struct(F.lit(-1).alias("last"), *(F.lit(0.0).alias(x) for x in ("total", "square", "next", "upper", "runs")))
    sums = F.aggregate("_values", start, lambda s, v: F.struct(
        v.alias("last"), (s["total"] + v).alias("total"), (s["square"] + v.cast("double") * v).alias("square"),
        (s["next"] + F.when(s["last"] < 0, 0.0).otherwise(s["last"].cast("double") * v)).alias("next"),
        (s["upper"] + F.when(v >= half, 1.0).otherwise(0.0)).alias("upper"),
        (s["runs"] + F.when((s["last"] < 0) | ((s["last"] >= half) != (v >= half)), 1.0).otherwise(0.0)).alias("runs")))
    rows = rows.withColumn("_s", sums).withColumn("_first", F.get("_values", F.lit(0)))
    n, total = F.col("_n"), F.col("_s.total")
    chi = F.col("_size") * F.col("_squares") / n - n
    uneven = F.sqrt(2 * F.greatest(chi, F.lit(0.0))) - F.sqrt(2 * F.col("_size") - 3)
    expected = 2 * F.col("_s.upper") * (n - F.col("_s.upper")) / n + 1
    spread = (expected - 1) * (expected - 2) / (n - 1)
    runs = F.when(spread > 0, F.abs(F.col("_s.runs") - expected) / F.sqrt(spread)).otherwise(F.sqrt(n))
    ends = 2 * total - F.col("_first") - F.col("_s.last")
    varied = F.col("_s.square") - total * total / n
    mean = total / n
    serial = F.when(varied > 0, F.abs((F.col("_s.next") - mean * ends + (n - 1) * mean * mean) / varied) * F.sqrt(n)).otherwise(F.sqrt(n))
    rows = rows.withColumns({"_uneven": uneven, "_runs": runs, "_serial": serial})
    score = (F.col("_uneven") + (F.col("_runs") - HALF_MEAN) / HALF_DEV + (F.col("_serial") - HALF_MEAN) / HALF_DEV) / math.sqrt(3)
    step = F.least(F.greatest(F.floor(score * STEPS), F.lit(LOWEST)), F.lit(HIGHEST)).cast("int")
    return rows.withColumns({out: F.when(F.col(text).isNotNull() & (n > 1), step), "symbols": F.col("_size").cast("int")}).drop(
        "_own", "_alphabet", "_n", "_size", "_squares", "_values", "_s", "_first", "_uneven", "_runs", "_serial")


def _length_class(size: Column) -> Column:
    return sum((F.when(size >= c, 1).otherwise(0) for c in CLASSES), F.lit(0))


def marks(docs: DataFrame) -> DataFrame:
    """One row per match that counts (uid, doc_id, kind, i, gap, size, counts), the runs' with score
    and a row for each of their decoys (number ``decoy`` from 1), and one row per
    document without any (kind null). Written to the shared folder."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    run = f"[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}"
    # the runs that are long enough are found by patterns of that length: of a maximal run the whole is matched in both
    kinds = [(ASSIGN, "(?i)password|passwd|secret|token|api_?key", 2, 12), ("AKIA[A-Z0-9]{14,}", "AKIA[A-Z0-9]{14}", 0, 18),
             ("[0-9a-f]{16,}", "[0-9a-f]{16}", 0, 16), (run, run, 0, LEAST)]
    found = []
    for kind, (pattern, quick, group, least) in enumerate(kinds):
        columns, matches = _marks("text", kind, pattern, quick, group, least)
        rows = rows.withColumns(columns)
        found.append(matches.cast(MARK))
    letters = F.regexp_replace(F.array_join(f"rest_{len(BASE)}", " "), "[^A-Za-z0-9]+", "")
    longest = F.array_max(F.transform(f"held_{len(BASE)}", F.char_length))
    rows = rows.select("uid", "doc_id", F.concat(*found).alias("marks"), F.when(longest.isNotNull(), F.substring(letters, F.lit(1), longest * DECOYS)).alias("letters"))
    rows = rows.select("uid", "doc_id", "letters", F.explode_outer("marks").alias("m"))
    decoys = F.transform(F.sequence(F.lit(0), F.lit(DECOYS - 1)), lambda k: F.substring(F.col("letters"), k * F.col("m.size") + 1, F.col("m.size")))
    decoys = F.filter(decoys, lambda d: F.char_length(d) == F.col("m.size"))
    tested = F.when(F.col("m.kind") == len(BASE), F.concat(F.array("m.text"), decoys)).otherwise(F.array(F.lit(None).cast("string")))
    rows = rows.select("uid", "doc_id", F.col("m.kind").alias("kind"), F.col("m.i").alias("i"), F.col("m.gap").alias("gap"), F.col("m.size").alias("size"),
                       F.col("m.text").isNotNull().alias("counts"), F.posexplode(tested).alias("decoy", "run"))
    rows = battery(rows, "run", "score").drop("run")
    return stored(rows, "secret-marks")


def bars(scored: DataFrame) -> DataFrame:
    """class, symbols, bar: the highest score of each class of lengths and size of alphabet that keeps the
    rate of false discoveries. A row for each of them and step at most is put in order."""
    rows = scored.where(F.col("score").isNotNull()).select(_length_class(F.col("size")).alias("class"), "symbols", "score", (F.col("decoy") == 0).cast("long").alias("run"))
    steps = rows.groupBy("class", "symbols", "score").agg(F.sum("run").alias("runs"), F.sum(1 - F.col("run")).alias("ordinary"))
    below = Window.partitionBy("class", "symbols").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("class")
    steps = steps.select("class", "symbols", "score", *(F.sum(c).over(w).cast("double").alias(n) for n, c, w in (
        ("met", "runs", below), ("ordinary", "ordinary", below), ("runs", "runs", every), ("decoys", "ordinary", every))))
    false = (F.col("ordinary") + 1) / (F.col("decoys") + 1) * F.col("runs")
    kept = steps.where((F.col("met") > 0) & (false <= F.col("met") * RATE) & (F.col("score") <= REJECT))
    return kept.groupBy("class", "symbols").agg(F.max("score").alias("bar"))


def spans(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: uid, doc_id and spans, an array of (start, kind number, end), base kinds
    first."""
    found = marks(docs)
    limit = F.broadcast(bars(found))  # a row for each class and alphabet
    own = found.where("decoy = 0").withColumn("class", _length_class(F.col("size"))).join(limit, ["class", "symbols"], "left").repartition("uid")
    order = Window.partitionBy("uid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum((F.col("gap") + F.col("size")).cast("long")).over(order)
    own = own.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    kept = F.col("kind").isNull() | (F.col("counts") & ((F.col("kind") < len(BASE)) | (F.col("score") <= F.col("bar"))))
    base_end = F.when((F.col("kind") < len(BASE)) & F.col("counts"), F.col("end"))
    held = F.max(base_end).over(Window.partitionBy("uid").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)) >= F.col("end")
    own = own.withColumn("held", F.coalesce(held, F.lit(False)))
    span = F.when(kept & F.col("kind").isNotNull() & ((F.col("kind") < len(BASE)) | ~F.col("held")), F.struct("start", "kind", "end"))
    return own.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(span)).alias("spans"))


def _listed(found: Column) -> Column:
    names = F.array(*(F.lit(name) for name, *_ in BASE), F.lit(RANDOM))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """Per row: counts of the base kinds and of random runs, sha256 of the base spans' list, all
    spans as ``kind:start:end`` by start and kind."""
    out = spans(docs)
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    counts = [of(k).alias(f"n_{name}") for k, (name, *_) in enumerate(BASE)] + [of(len(BASE)).alias(f"n_{RANDOM}")]
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return out.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
