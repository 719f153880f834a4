"""Phrase collocation mining by stripes.

Per language, each prefix of 0 to ``LONGEST`` - 1 words keys an associative counter of next
words, its stripe. From the stripes alone come

* extensions: entry (prefix, next) counts the phrase ``prefix next``;
* prefix totals: the stripe of the empty prefix counts the words, its total all of them;
  a phrase's parts are entries of shorter prefixes' stripes;
* subsumption maxima: the largest entry of a longer phrase that holds a shorter one.

A task counts its texts' stripes in memory-bounded pieces and sends each stripe once a piece, as
a pair of lists. Stripes of one key are merged element by element where they meet, in Spark's
aggregate, which spills. Prefixes of n words are extended round by round: a phrase can
have ``LEAST`` occurrences only if its first and its last n words have, so other positions
send nothing; which phrases do is asked of a bitmap of bounded size (``IdFilter``) that may
say yes too often, and the counts that follow are exact.

A stripe isn't one task's: a prefix with a share s of all positions of its length is dealt
in ceil(s * ``PARTS``) parts by the hash of the next word, so no part stands for more than about
one in ``PARTS`` positions, except for a single phrase, whose count each task sends as one number.
Prefixes with more than one part are at most ``PARTS``, so their list is bounded.

Texts are cut at ``.,;:!?`` and line breaks into pieces, these at blanks and tabs into words, with
A-Z lower-cased. Null and empty texts have no words; a null language is ``und``; rows that
repeat count each time; an empty table gives no rows. Texts of any length are read in parts
that overlap by the prefix. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.llm.common import IdFilter, lean, mixed, pieces, stored

#: Words of the longest phrase, occurrences a phrase needs, phrases a language reports.
LONGEST, LEAST, TOP = 4, 30, 2000
#: A phrase goes if a longer one that holds it has this share of its occurrences, in percent.
SUBSUMED = 80
SCALE = 2_000_000
#: Parts that the stripe of all positions is dealt in.
PARTS = 1000
#: Bytes of text counted at once by a task.
COUNT_BYTES = 6 << 20
#: Rows of a language that are put in order in one task before its first ones are taken.
RANKS = 64
BREAK = b"."
#: A-Z to a-z, a tab to a blank, every sign that ends a piece to the break.
_SIGNS = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 46 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_U = np.uint64
STRIPES = "lang string, prefix string, part int, words array<string>, counts array<long>"


def _cut(data: bytes, size: int) -> Iterator[bytes]:
    """Parts of about ``size`` bytes, none ending inside a word."""
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            end = data.find(b" ", end)
            end = len(data) if end < 0 else end
        yield data[at:end]
        at = end


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def run_ids(hashes: np.ndarray, lang: str) -> np.ndarray:
    """One number for each row of word hashes (n x words) of a language."""
    total = np.full(len(hashes), word_hash(lang.encode()), _U)
    for k in range(hashes.shape[1]):
        total += mixed(hashes[:, k]) * _ODD[k]
    return mixed(total).view(np.int64)


def phrase_ids(phrases: DataFrame) -> DataFrame:
    """``id`` of each phrase (lang, phrase), as ``run_ids`` numbers it."""
    def ids(batches):
        for b in batches:
            for lang, rows in _by_lang(b.column(0)):
                words = [p.encode().split(b" ") for p in b.column(1).take(rows).to_pylist()]
                hashes = np.array([[word_hash(w) for w in own] for own in words], _U)
                yield pa.RecordBatch.from_arrays([pa.array(run_ids(hashes, lang))], ["id"])

    return phrases.select("lang", "phrase").mapInArrow(ids, "id long")


def _by_lang(langs: pa.Array) -> Iterator[tuple[str, pa.Array]]:
    codes = langs.dictionary_encode()
    own = codes.indices.to_numpy(zero_copy_only=False)
    for k, lang in enumerate(codes.dictionary.to_pylist()):
        yield lang, pa.array(np.flatnonzero(own == k))


def _counted(lang: str, words: list[bytes], n: int, frequent: IdFilter | None, deal: dict[int, int]) -> pa.RecordBatch | None:
    """Stripes of all prefixes of ``n`` words in a row of words and breaks."""
    if len(words) <= n:
        return None
    own = pa.array(words, pa.binary()).dictionary_encode()
    ids, vocabulary = own.indices.to_numpy(zero_copy_only=False).astype(np.int64), own.dictionary
    known = vocabulary.to_pylist()
    size = len(known)
    ok = np.array([w != BREAK for w in known])[ids]
    inside = np.ones(len(ids) - n, bool)
    for k in range(n + 1):
        inside &= ok[k:len(ids) - n + k]
    at = np.flatnonzero(inside)
    hashes = np.fromiter((word_hash(w) for w in known), _U, size)
    prefix_id = None
    if n:
        spread = np.lib.stride_tricks.sliding_window_view(ids, n)
        for shift in (1, 0):  # the last n words, the first n
            prefix_id = run_ids(hashes[spread[at + shift]], lang)
            keep = frequent.has(prefix_id)
            at, prefix_id = at[keep], prefix_id[keep]
    if not len(at):
        return None
    # a number for each prefix: n words, two at a time
    prefix = np.zeros(len(at), np.int64)
    for k in range(n):
        _, prefix = np.unique(prefix * size + ids[at + k], return_inverse=True)
    _, first = np.unique(prefix, return_index=True)
    parts = np.array([deal.get(int(prefix_id[f]), 1) for f in first], np.int64) if n else np.array([PARTS])
    after = ids[at + n]
    part = (hashes >> _U(33)).astype(np.int64)[after] % parts[prefix]
    entries, counts = np.unique((prefix * PARTS + part) * size + after, return_counts=True)
    stripe, word = entries // size, entries % size
    begins = np.flatnonzero(np.concatenate([[True], stripe[1:] != stripe[:-1]]))
    offsets = pa.array(np.concatenate([begins, [len(word)]]), pa.int32())
    text = vocabulary.cast(pa.string())
    of = at[first[stripe[begins] // PARTS]]
    prefixes = [text.take(pa.array(ids[of + k])).to_pylist() for k in range(n)]
    return pa.RecordBatch.from_arrays([
        pa.array([lang] * len(begins)), pa.array([" ".join(p) for p in zip(*prefixes)] if n else [""] * len(begins), pa.string()),
        pa.array((stripe[begins] % PARTS).astype(np.int32)),
        pa.ListArray.from_arrays(offsets, text.take(pa.array(word))), pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int64)))],
        ["lang", "prefix", "part", "words", "counts"])


def stripes(docs: DataFrame, n: int, frequent: IdFilter | None, deal: dict[int, int]) -> DataFrame:
    """The stripes of prefixes of ``n`` words that tasks have counted (``STRIPES``).
    ``frequent`` has all phrases of ``n`` words that occur ``LEAST`` times, ``deal`` the parts of
    prefixes that have several."""
    seen = docs.sparkSession.sparkContext.broadcast((frequent, deal))

    def count(batches):
        frequent_, deal_ = seen.value
        for batch in batches:
            for piece, texts in pieces(batch, "text", COUNT_BYTES):
                for lang, rows in _by_lang(piece.column(0)):
                    data = (b"\n".join(texts[k] for k in rows.to_pylist()) + b"\n").translate(_SIGNS)
                    before: list[bytes] = []  # the last n words, which the next part's phrases may begin with
                    for part in _cut(data, COUNT_BYTES):
                        words = before + part.replace(BREAK, b" . ").split()
                        out = _counted(lang, words, n, frequent_, deal_)
                        if out is not None:
                            yield out
                        before = words[-n:] if n else []

    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(lean(count), STRIPES)


def merged(sent: DataFrame) -> DataFrame:
    """lang, prefix, word, n: stripes of a key summed element by element, where the shuffle
    has brought them together."""
    met = sent.repartition("lang", "prefix", "part")
    entries = met.select("lang", "prefix", "part", F.explode(F.arrays_zip("words", "counts")).alias("e"))
    return entries.groupBy("lang", "prefix", "part", F.col("e.words").alias("word")).agg(F.sum("e.counts").alias("n"))


def counts_of_words(docs: DataFrame) -> DataFrame:
    """lang, phrase, n of every word: the empty prefix's stripe."""
    return merged(stripes(docs, 0, None, {})).select("lang", F.col("word").alias("phrase"), "n")


def _deal(phrases: DataFrame, positions: int) -> dict[int, int]:
    """Parts of the prefixes that have more than a ``PARTS``-th of all positions: fewer than ``PARTS`` rows."""
    hot = phrases.where(F.col("n") * PARTS > positions).select("lang", "phrase", "n").collect()
    out = {}
    for r in hot:
        hashes = np.array([[word_hash(w.encode()) for w in r["phrase"].split(" ")]], _U)
        out[int(run_ids(hashes, r["lang"])[0])] = -(-PARTS * r["n"] // positions)
    return out


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Two tables: (lang, words, phrase, n) of every phrase of 1 to ``longest`` words with
    ``least`` occurrences, and (lang, n) of all words."""
    every = stored(counts_of_words(docs), "stripes-words")
    totals = every.groupBy("lang").agg(F.sum("n").alias("n"))
    positions = every.agg(F.sum("n")).first()[0] or 1
    known = stored(every.where(F.col("n") >= least), "stripes-1")
    found = [known.withColumn("words", F.lit(1))]
    for n in range(1, longest):
        entries = merged(stripes(docs, n, IdFilter.of(phrase_ids(known)), _deal(known, positions)))
        longer = entries.where(F.col("n") >= least).select("lang", F.concat_ws(" ", "prefix", "word").alias("phrase"), "n")
        known = stored(longer, f"stripes-{n + 1}")
        found.append(known.withColumn("words", F.lit(n + 1)))
    phrases = found[0]
    for more in found[1:]:
        phrases = phrases.unionByName(more)
    return phrases, totals


def collocations(docs: DataFrame, top: int | None = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's phrases of 2 to ``LONGEST`` words by
    the score of their weakest cut, without those that a longer phrase stands for; all of
    them with ``top`` None."""
    phrases, totals = frequent_phrases(docs)
    candidates = phrases.where("words > 1").withColumn("a", F.col("n").cast("decimal(38,0)"))

    # a word or pair may be part of very many candidates: their side is dealt by the candidate as well, the counts' side repeated
    salts, salt = 8, F.pmod(F.xxhash64("phrase"), F.lit(8)).cast("int")
    w = F.split("phrase", " ")
    cuts = F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(
        k.alias("k"), F.array_join(F.slice(w, F.lit(1), k), " ").alias("left"), F.array_join(F.slice(w, k + 1, F.col("words") - k), " ").alias("right")))
    cut = candidates.select("lang", "phrase", "a", salt.alias("salt"), F.explode(cuts).alias("c")).select("lang", "phrase", "a", "salt", "c.*")
    parts = phrases.where(F.col("words") < LONGEST).select("lang", F.col("phrase").alias("part"), F.col("n").cast("decimal(38,0)").alias("f"),
                                                           F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    cut = cut.join(parts.select("lang", "salt", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "salt", "left"])
    cut = cut.join(parts.select("lang", "salt", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "salt", "right"])
    cut = cut.withColumn("score", F.expr(f"cast(cast({SCALE} as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)"))
    weakest = cut.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("c"))

    inner = F.filter(
        F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(
            F.sequence(F.lit(1), F.col("words") - m + 1), lambda s: F.array_join(F.slice(w, s, m), " ")))), lambda p: p != "")
    held = candidates.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "a")
    held = held.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = weakest.join(held, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("c.a") * SUBSUMED))
    kept = kept.select("lang", "phrase", *(F.col(f"c.{x}").cast("long").alias(x) for x in ("a", "l", "r", "score")))

    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    if top is not None:  # the first of a language are among the first of its parts
        some = Window.partitionBy("lang", "part").orderBy(*best)
        kept = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANKS))).withColumn("rank", F.row_number().over(some))
        kept = kept.where(F.col("rank") <= top).drop("part", "rank")
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")) if top is not None else kept
    kept = kept.where(F.col("rank") <= top) if top is not None else kept
    kept = kept.join(totals, "lang")
    return kept.select("lang", *(["rank"] if top is not None else []), "phrase", "a", "l", "r", F.col("n").cast("long").alias("n"), "score")
