"""Document fingerprints: a homomorphic hash of the multiset of paragraphs.

A text is a multiset of paragraphs: its pieces between line breaks and sentence ends,
without blanks around them; empty ones do not count. Each is hashed to a wide vector,
and a document's fingerprint is the sum of its vectors, lane by lane, modulo powers of two:

* a lane that counts paragraphs, modulo 2^32;
* ``DENSE`` lanes of the paragraph's hash under different seeds, modulo 2^48: equal
  multisets have equal sums in any order, and others differ but for 1 in 2^(48 * DENSE);
* ``SIGNS`` lanes of one hash bit each, modulo 2^16. Read as signs, the squared distance
  of two sums estimates the size of the multisets' difference, so two fingerprints
  alone give a likeness: estimated intersection over union.

Sums make the hash incremental: ``combine`` adds the fingerprint of inserted
paragraphs or takes away that of deleted ones, without the document.

Everything is DataFrame expressions. A null text is empty; the empty text is the zero
vector, and two of them have likeness 1. Rows follow each other in ascending doc_id
order, null first, equal ids by a hash of the text; a single row is its own next. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Dense lanes and their power.
DENSE, DENSE_BITS = 4, 48
#: Sign lanes: two hash words of 64 bits.
SIGNS, SIGN_BITS = 128, 16
#: Between paragraphs: line breaks, or blanks after a sentence's end.
BETWEEN = r"\s*\n\s*|(?<=[.!?])\s+"
#: Rows of a doc_id range that is put in order at a time, at most this many ranges.
RANGE_ROWS, RANGES = 2000, 10_000
_DENSE_MASK, _SIGN_MASK, _PAIR = (1 << DENSE_BITS) - 1, (1 << SIGN_BITS) - 1, 0x0000000100000001


def paragraphs(text: Column) -> Column:
    """Array of a text's paragraphs."""
    return F.filter(F.split(F.trim(text), BETWEEN), lambda p: p != "")


def vector(text: Column) -> Column:
    """The fingerprint of a text as array<long>: count, dense lanes, sign lanes. Two sign
    lanes are summed in one number, 32 bits each, which no text's paragraphs fill."""
    words = F.transform(paragraphs(text), lambda p: F.struct(F.xxhash64(p, F.lit(1)).alias("a"), F.xxhash64(p, F.lit(2)).alias("b")))
    # the transform of one element names the hashes, so that they are made once
    return F.transform(F.array(words), _sums)[0]


def _sums(hashes: Column) -> Column:
    """Lanes from the paragraphs' pairs of hash words."""
    zero = F.lit(0).cast("long")
    dense = [_dense(hashes, zero, k) for k in range(DENSE)]
    pairs = F.concat(_sign_pairs(hashes, zero, "a"), _sign_pairs(hashes, zero, "b"))
    # number s of a word's 32 holds the sums of bits s and s + 32
    mask = F.lit(_SIGN_MASK).cast("long")
    low = F.transform(pairs, lambda p: p.bitwiseAND(mask))
    high = F.transform(pairs, lambda p: F.shiftrightunsigned(p, 32).bitwiseAND(mask))
    return F.concat(F.array(F.size(hashes).cast("long"), *dense), low, high)


def _dense(hashes: Column, zero: Column, k: int) -> Column:
    mask = F.lit(_DENSE_MASK).cast("long")
    return F.aggregate(hashes, zero, lambda s, h: (s + F.xxhash64(h["a"], h["b"], F.lit(k)).bitwiseAND(mask)).bitwiseAND(mask))


def _sign_pairs(hashes: Column, zero: Column, word: str) -> Column:
    mask = F.lit(_PAIR).cast("long")
    return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda s: F.aggregate(
        hashes, zero, lambda total, h: total + F.call_function("shiftrightunsigned", h[word], s).bitwiseAND(mask)))


def combine(left: Column, right: Column, sign: int = 1) -> Column:
    """Fingerprint of the union of two multisets (``sign`` 1), or of what is left of
    ``left`` without ``right`` (-1)."""
    sums = F.zip_with(left, right, lambda a, b: a + b * sign)
    return F.transform(sums, lambda x, i: F.when(i == 0, x.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
                       .when(i <= DENSE, x.bitwiseAND(F.lit(_DENSE_MASK).cast("long")))
                       .otherwise(x.bitwiseAND(F.lit(_SIGN_MASK).cast("long"))))


def text_of(lanes: Column) -> Column:
    """A fingerprint as hex: 8 digits, then 12 by dense lane, then 4 by sign lane."""
    digits = F.transform(lanes, lambda x, i: F.lpad(F.hex(x), F.when(i == 0, 8).when(i <= DENSE, 12).otherwise(4), "0"))
    return F.lower(F.array_join(digits, ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated intersection over union of two fingerprints' multisets, 0 to 1; 1 for
    equal fingerprints."""
    both = F.zip_with(F.slice(a, DENSE + 2, SIGNS), F.slice(b, DENSE + 2, SIGNS), lambda x, y: x - y)
    more = F.get(a, F.lit(0)) - F.get(b, F.lit(0))
    # differences are taken modulo 2^16, nearest to 0, as the lanes are
    signed = F.transform(both, lambda d: F.pmod(2 * d - more + (1 << SIGN_BITS - 1), F.lit(1 << SIGN_BITS)) - (1 << SIGN_BITS - 1))
    apart = F.aggregate(signed, F.lit(0.0), lambda s, d: s + d.cast("double") * d) / SIGNS
    total = (F.get(a, F.lit(0)) + F.get(b, F.lit(0))).cast("double")
    shared = (total - apart) / 2
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), shared / F.greatest(total - shared, F.lit(1e-9))))
    return F.when(a == b, 1.0).otherwise(value)


def _range_of(bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most doc_id, by halving; none for a null, which
    is before all ids."""
    def half(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") < bounds[mid], half(lo, mid)).otherwise(half(mid + 1, hi))

    return F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(half(0, len(bounds)))


def with_next(rows: DataFrame, derived: dict[str, Column]) -> DataFrame:
    """``rows`` (doc_id, text) with the derived columns and, as next_<name>, text and derived
    columns of the row after, in ascending doc_id order; the first row comes after the
    last. Rows are dealt by doc_id ranges whose bounds are ids of the table. The rows at a
    bound are dealt to the range before it as well, as guests, so a range has all the
    next rows it needs. Columns are derived once for each dealt row."""
    sizes = rows.agg(F.count("*").alias("n"), F.count("doc_id").alias("known")).first()
    n_ranges, bounds = min(RANGES, sizes["known"] // RANGE_ROWS), []
    if n_ranges > 1:
        shares = [k / n_ranges for k in range(1, n_ranges)]
        bounds = sorted(set(rows.agg(F.percentile_approx("doc_id", shares, 10 * RANGES)).first()[0]))
    dealt = rows.withColumns({"range": _range_of(bounds) if bounds else F.lit(0), "guest": F.lit(0)})
    if bounds:
        at_bound = rows.where(F.col("doc_id").isin(bounds))
        dealt = dealt.unionByName(at_bound.withColumns({"range": _range_of(bounds) - 1, "guest": F.lit(1)}))
    first = rows.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")) if sizes["known"] < sizes["n"] else rows.join(
        rows.agg(F.min("doc_id").alias("least")), F.col("doc_id") == F.col("least")).drop("least").orderBy(F.xxhash64("text"))
    dealt = dealt.unionByName(first.limit(1).withColumns({"range": F.lit(len(bounds)), "guest": F.lit(2)}))
    order = Window.partitionBy("range").orderBy(F.col("guest") == 2, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "guest")
    dealt = dealt.withColumns(derived)
    dealt = dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in ("text", *derived)})
    return dealt.where("guest = 0").drop("range", "guest")


def plain(docs: DataFrame) -> DataFrame:
    """doc_id and text of each row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text, lanes of each row."""
    return plain(docs).withColumn("lanes", vector(F.col("text")))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: its fingerprint, that of its edited text (the second half replaced by as
    much of the next document's beginning), and their likenesses."""
    rows = with_next(plain(docs), {"lanes": vector(F.col("text"))})
    n = F.char_length("text")
    rows = rows.withColumn("n", n).withColumn("edited", F.expr("concat(substring(text, 1, n - n div 2), substring(next_text, 1, cast(n div 2 as int)))"))
    rows = rows.select("doc_id", "n", "lanes", "next_lanes", F.sha2("edited", 256).alias("edited_sha256"), vector(F.col("edited")).alias("edited_lanes"))
    return rows.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), "edited_sha256", text_of(F.col("lanes")).alias("fingerprint"),
        text_of(F.col("edited_lanes")).alias("edited_fingerprint"), likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"),
        likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"))
