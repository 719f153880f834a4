"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

A benchmark item's windows are its runs of ``n`` words (A-Z lower-cased, words
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``); an item of fewer words, but not none, is one
window. Window hashes are looked up for every window of every document, a hit is
verified word by word, and all words inside a verified window are hit. The hit spans
can be removed, or the document dropped.

The benchmark's windows are broadcast only up to ``BROADCAST_WINDOWS``, by an estimate from the
texts' lengths. Beyond it they stay a table: the documents are scanned once, windows that a bitmap of
bounded size (``IdFilter``) may know are joined with it by length, hash and words, and nothing of the
benchmark comes to the driver. Results are the same.

Null and empty texts have no words and no hits; items without words match nothing;
equal items all count; a null item_id is reported as an empty name; an empty benchmark
hits nothing and an empty table gives no rows. Repeated documents are each returned.
Other columns pass ``remove_hits`` unchanged.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import alnum_words, claim, free, IdFilter, LOWER, pieces, ship, stored, WordTable

WINDOW = 10
#: Windows of the benchmark that one broadcast may hold: about 200 bytes each.
BROADCAST_WINDOWS = 500_000
#: Bits of the table that turns away most windows before the sorted hashes are searched.
SIEVE_BITS = 22
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MIX = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64 | 1) for k in range(64)]

_word_hash = WordTable(xxhash.xxh3_64_digest)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.frombuffer(b"".join(map(_word_hash.__getitem__, words)), ">u8").astype(np.uint64)


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words: a sum of odd multiples, then mixed."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out += hashes[k:k + m] * _MIX[k]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


class BenchmarkIndex:
    """Sorted window hashes of a bounded benchmark by window length, the words behind each, and
    a sieve."""

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        found: dict[int, dict[int, dict[tuple, set]]] = defaultdict(lambda: defaultdict(lambda: defaultdict(set)))
        for item, text in items:
            words = alnum_words(text)
            size = min(n, len(words))
            if not size:
                continue
            for k, h in enumerate(window_hashes(word_hashes(words), size).tolist()):
                found[size][h][tuple(words[k:k + size])].add(item)
        self.by_size = {}
        for size, table in found.items():
            keys = np.array(sorted(table), np.uint64)
            sieve = np.zeros(1 << SIEVE_BITS, bool)
            sieve[keys >> np.uint64(64 - SIEVE_BITS)] = True
            self.by_size[size] = keys, sieve, {h: dict(v) for h, v in table.items()}

    def hits(self, words: list[bytes], hashes: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        """Verified windows of one document as (first word, length), and the items."""
        spans, items = [], set()
        for size, (keys, sieve, table) in self.by_size.items():
            own = window_hashes(hashes, size)
            near = np.flatnonzero(sieve[own >> np.uint64(64 - SIEVE_BITS)])
            if not len(near):
                continue
            got = own[near]
            at = np.minimum(np.searchsorted(keys, got), len(keys) - 1)
            for k in near[keys[at] == got].tolist():
                owners = table[int(own[k])].get(tuple(words[k:k + size]))
                if owners:
                    spans.append((k, size))
                    items |= owners
        return spans, items


def benchmark_rows(benchmark: DataFrame) -> DataFrame:
    """(item, text) of each item, null as empty."""
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def fits(items: DataFrame, bound: int) -> bool:
    """Whether the benchmark's windows are at most ``bound`` (a word has a byte and a blank at least)."""
    most = items.agg(F.sum(F.expr("octet_length(text) div 2 + 1"))).first()[0] or 0
    return most <= bound


def _scan(docs: DataFrame, items: DataFrame, n: int, schema: str, emit) -> DataFrame:
    """``emit(piece, texts, index)`` over the documents, the index of a bounded benchmark broadcast."""
    ship(docs.sparkSession)
    rows = [(r["item"], r["text"].encode()) for r in items.collect()]  # bounded by ``fits``
    held = docs.sparkSession.sparkContext.broadcast(rows)
    key = xxhash.xxh3_64_intdigest(b"\0".join(i.encode() + b"\1" + t for i, t in sorted(rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = worker_index(key, n, held)
        for batch in batches:
            for piece, texts in pieces(batch, "text"):
                yield emit(piece, texts, index)

    return docs.mapInArrow(run, schema)


# ---- a benchmark beyond the bound --------------------------------------------------

#: The benchmark's side of the join is repeated so often, and the documents' dealt by as many salts.
SALTS = 8


def window_rows(items: DataFrame, n: int) -> DataFrame:
    """(size, hash, window, item): each item's windows, once."""
    def run(batches):
        for batch in batches:
            for piece, texts in pieces(batch, "text"):
                for item, text in zip(piece.column("item").to_pylist(), texts):
                    words = alnum_words(text)
                    size = min(n, len(words))
                    if not size:
                        continue
                    hashes = window_hashes(word_hashes(words), size).view(np.int64)
                    for lo in range(0, len(hashes), 4096):
                        own = hashes[lo:lo + 4096]
                        texts_ = [b" ".join(words[k:k + size]) for k in range(lo, lo + len(own))]
                        yield pa.RecordBatch.from_arrays([pa.array([size] * len(own), pa.int32()), pa.array(own), pa.array(texts_, pa.binary()),
                                                          pa.array([item] * len(own), pa.string())], ["size", "hash", "window", "item"])

    return items.mapInArrow(run, "size int, hash long, window binary, item string").distinct()


def likely_windows(docs: DataFrame, sizes: list[int], known: IdFilter) -> DataFrame:
    """(uid, doc_id, n_words, likely): of each document (uid, doc_id, text) the windows whose hash may be
    the benchmark's."""
    held = docs.sparkSession.sparkContext.broadcast(known)  # IdFilter.MOST_BITS at most

    def run(batches):
        for batch in batches:
            for piece, texts in pieces(batch, "text"):
                counts, likely = [], []
                for text in texts:
                    words = alnum_words(text)
                    hashes, own = word_hashes(words), []
                    for size in sizes:
                        found = window_hashes(hashes, size).view(np.int64)
                        for k in np.flatnonzero(held.value.has(found)).tolist():
                            own.append({"at": k, "size": size, "hash": int(found[k]), "window": b" ".join(words[k:k + size])})
                    counts.append(len(words))
                    likely.append(own)
                kind = pa.list_(pa.struct([("at", pa.int64()), ("size", pa.int32()), ("hash", pa.int64()), ("window", pa.binary())]))
                yield pa.RecordBatch.from_arrays([piece.column("uid"), piece.column("doc_id"), pa.array(counts, pa.int64()), pa.array(likely, kind)],
                                                 ["uid", "doc_id", "n_words", "likely"])

    return docs.mapInArrow(run, "uid long, doc_id long, n_words long, likely array<struct<at:long,size:int,hash:long,window:binary>>")


def joined_hits(docs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """(uid, doc_id, n_words, spans, items) of each document (uid, doc_id, text): the verified windows as (at, size),
    and the items that have them, ascending; null without any."""
    windows = stored(window_rows(items, n), "benchmark-windows")
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # n of them at most
    rows = stored(likely_windows(docs, sizes, IdFilter.of(windows.select("hash"))), "benchmark-likely")
    every = windows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    likely = rows.select("uid", F.explode("likely").alias("w")).select("uid", "w.*", F.pmod("uid", F.lit(SALTS)).cast("int").alias("salt"))
    hits = likely.join(every, ["size", "hash", "window", "salt"])
    per_doc = hits.groupBy("uid").agg(F.collect_set(F.struct("at", "size")).alias("spans"), F.sort_array(F.collect_set("item")).alias("items"))
    return rows.drop("likely").join(per_doc, "uid", "left")


def hit_words(spans):
    """Words inside any of an array of (at, size)."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach"))
    return F.aggregate(F.array_sort(spans), zero, lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0).cast("long"), s["at"] + s["size"] - F.greatest(a["reach"], s["at"]))).alias("n"),
        F.greatest(a["reach"], s["at"] + s["size"]).alias("reach")), lambda a: a["n"])


# ---- a bounded one -------------------------------------------------------------------

_INDEX: dict = {}


def worker_index(key, n, held) -> BenchmarkIndex:
    """The worker's index of a benchmark, kept between tasks (one at a time)."""
    claim("benchmark", lambda: (_INDEX.clear(), _word_hash.clear()))
    if (key, n) not in _INDEX:
        _INDEX.clear()
        _INDEX[key, n] = BenchmarkIndex(held.value, n)
    return _INDEX[key, n]


def covered(spans, n_words: int) -> np.ndarray:
    """Which of the words lie inside any of the spans."""
    edge = np.zeros(n_words + 1, np.int64)
    for k, size in spans:
        edge[k] += 1
        edge[k + size] -= 1
    return np.cumsum(edge[:-1]) > 0


def digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _digest_batch(rows, piece) -> pa.RecordBatch:
    n_words, n_hit, items = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [piece.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
         pa.array([len(x) for x in items], pa.int64()), pa.array([digest(x) for x in items], pa.string()),
         pa.array([h > 0 for h in n_hit], pa.bool_())],
        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def _per_doc(texts, index):
    for text in texts:
        words = alnum_words(text)
        spans, items = index.hits(words, word_hashes(words))
        yield words, spans, items


RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, bound: int = BROADCAST_WINDOWS) -> DataFrame:
    """Per document: words, hit words, items with occurring windows."""
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    items = benchmark_rows(benchmark)
    if fits(items, bound):
        def emit(piece, texts, index):
            return _digest_batch([(len(w), int(covered(s, len(w)).sum()) if s else 0, i) for w, s, i in _per_doc(texts, index)], piece)

        return _scan(own, items, n, RESULT, emit)

    found = joined_hits(own.withColumn("uid", F.monotonically_increasing_id()), items, n)
    n_hit, n_items = F.coalesce(hit_words(F.col("spans")), F.lit(0).cast("long")), F.coalesce(F.size("items"), F.lit(0))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.when(n_items > 0, n_items).otherwise(0).cast("long").alias("n_items"),
                        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def remove_hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, drop_share: float = 0.5,
                bound: int = BROADCAST_WINDOWS) -> DataFrame:
    """``docs`` without benchmark text: the bytes from the first to the last word of
    each hit run are removed; a document of which at least ``drop_share`` of the words
    are hit is dropped. All columns stay; ``n_chars`` follows the text if there is one."""
    columns, schema = docs.columns, docs.schema

    def without(piece, texts, spans_of_rows):
        kept, new = [], []
        for row, (text, spans) in enumerate(zip(texts, spans_of_rows)):
            if spans:
                n_words = len(alnum_words(text))
                hit = covered(spans, n_words)
                if hit.sum() >= drop_share * n_words:
                    continue
            kept.append(row)
            new.append(cut(text, hit).decode() if spans else piece.column("text")[row].as_py())
        at, left = piece.schema.get_field_index("text"), piece.take(pa.array(kept, pa.int64()))
        return pa.RecordBatch.from_arrays(
            [pa.array(new, pa.string()) if k == at else left.column(k) for k in range(len(columns))], names=columns)

    items = benchmark_rows(benchmark)
    if fits(items, bound):
        out = _scan(docs, items, n, schema, lambda piece, texts, index: without(piece, texts, [s for _, s, _ in _per_doc(texts, index)]))
    else:
        # the rows are packed, so that their names meet none of these
        held = stored(docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.monotonically_increasing_id().alias("uid")), "benchmark-rows")
        own = held.select("uid", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text"))
        spans = joined_hits(own, items, n).where("spans is not null").select("uid", "spans")
        name = free("spans", docs)

        def run(batches):
            for batch in batches:
                for piece, texts in pieces(batch, "text"):
                    found = [[(s["at"], s["size"]) for s in own or ()] for own in piece.column(name).to_pylist()]
                    yield without(piece, texts, found)

        out = held.join(spans, "uid", "left").select("row.*", F.col("spans").alias(name)).mapInArrow(run, schema)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(schema["n_chars"].dataType))
    return out.select(*(F.col(f"`{c}`") for c in columns))


def cut(text: bytes, hit: np.ndarray) -> bytes:
    """The text without its hit runs."""
    out, at = [], 0
    places = [m.span() for m in WORD.finditer(text.translate(LOWER))]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        out.append(text[at:places[a][0]])
        at = places[b - 1][1]
    return b"".join(out) + text[at:]
