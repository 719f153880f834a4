"""Helpers that the operators of this package share.

Texts travel to Python as Arrow batches; a batch is cut into pieces of a bounded
number of bytes, so a worker's memory does not depend on the length of a text
times the batch's row count. Words are cached by a bounded table: natural text
repeats its words, and looking a word up costs far less than hashing it anew.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Spark removes the shuffle files of a query when it ends.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of an Arrow batch on its way to a Python worker, held there and in the executor; Spark's own limit is 64 MB.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
#: Bytes of text handled at once inside a Python worker.
PIECE_BYTES = 4 << 20
#: Bytes that are hashed at once, more for a longer word: the numbers made of them stay in a core's cache.
HASH_BYTES = 1 << 16
#: Bytes that a worker's word table may hold, about; words longer than a key are not kept.
CACHE_BYTES, LONGEST_KEY = 32 << 20, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by a path that only Spark needs to open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this library's sources to the Python workers of the session, which need not
    have it installed. Once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="ledgerflow-src-")) / "ledgerflow.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(to))
    _SHIPPED.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, a scratch folder
    is made for a local session; on a cluster that is an error."""
    at = spark.conf.get(CHECKPOINT_KEY, None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="ledgerflow-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set(CHECKPOINT_KEY, at)
    return at.rstrip("/")


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """The queries that run in this block leave no shuffle files: else those of every step stay on
    the executors' disks until the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP_KEY)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP_KEY, before)


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of the queries that run in this block have ``BATCH_BYTES`` at most, about; one row at least."""
    before = spark.conf.get(BATCH_KEY)
    most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)
    spark.conf.set(BATCH_KEY, str(min(most, BATCH_BYTES) if most > 0 else BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(BATCH_KEY, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: lineage is
    cut, its shuffle files go, and the files outlive any executor. Batches for Python are small
    meanwhile. No schema inference is run."""
    spark = df.sparkSession
    ship(spark)
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with tidy(spark), small_batches(spark):
        df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def free(name: str, *taken) -> str:
    """``name``, with as many underscores as it takes to differ from all names of the frames ``taken``, in
    any case of letters."""
    used = {c.lower() for df in taken for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def forget(df: DataFrame) -> None:
    """Remove the files of a ``stored`` frame that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    bare = lambda p: "/" + p.removeprefix("file:").lstrip("/")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if bare(folder).startswith(bare(shared_dir(spark)) + "/"):
            at = path(folder)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def runs_of(texts: list[bytes], size: int) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of texts, each of about ``size`` bytes, one text at least."""
    a, held = 0, 0
    for b, text in enumerate(texts, 1):
        held += len(text)
        if held >= size or b == len(texts):
            yield a, b
            a, held = b, 0


def pieces(batch: pa.RecordBatch, column: str, size: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch with their UTF-8 texts, null as empty, of about ``size``
    bytes each (one text at least)."""
    texts = batch.column(column)
    if not pa.types.is_binary(texts.type):
        texts = texts.cast(pa.binary())
    at, n = 0, batch.num_rows
    while at < n:
        held, took, out = 0, 0, []
        while at + took < n and (not out or held < size):
            x = texts[at + took].as_py() or b""
            out.append(x)
            held += len(x)
            took += 1
        yield batch.slice(at, took), out
        at += took


class WordTable(dict):
    """word -> packed value, filled by ``make`` on a miss, of ``bound`` bytes at most, about. When
    half of that is reached, the entries become the old generation and the one before
    goes; an old word that is asked for is young again, so frequent words stay. Words over
    ``LONGEST_KEY`` (texts without blanks) are made anew each time."""

    ENTRY_BYTES = 110  # of the table itself, for an entry

    def __init__(self, make: Callable[[bytes], bytes], bound: int = CACHE_BYTES):
        super().__init__()
        self.make, self.bound, self.old, self.held = make, bound, {}, 0

    def __missing__(self, word):
        self.turn()
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        self.keep(word, value)
        return value

    def peek(self, word):
        """The value held for a word, or None."""
        return self[word] if word in self else self.old.get(word)

    def keep(self, word, value) -> None:
        if len(word) <= LONGEST_KEY and word not in self:
            self[word] = value
            self.held += self.ENTRY_BYTES + sys.getsizeof(word) + sys.getsizeof(value)

    def find(self, words: list[bytes]) -> list:
        """The values held for words, or None."""
        old = self.old
        return [self[w] if w in self else old.get(w) for w in words]

    def keep_all(self, words: list[bytes], values: list[bytes], new: list[int] | None = None) -> None:
        """Words that ``find`` was asked for, with their values; ``new``: the places of those it didn't know. These
        are held, and the others are young again."""
        for word, value in zip(words, values):
            self.keep(word, value)
        self.turn()

    def turn(self) -> None:
        """A new generation where the young one has half of the bound."""
        if 2 * self.held > self.bound:
            self.old, self.held = self.copy(), 0
            super().clear()

    def copy(self) -> dict:
        return dict(self)

    def clear(self) -> None:
        super().clear()
        self.old, self.held = {}, 0


def flat(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words in a row, and where each begins, with the end."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)), out=edge[1:])
    return np.frombuffer(b"".join(words), np.uint8), edge


def gather(data: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Stretches of ``n`` items from ``first`` on, in a row."""
    edge = np.cumsum(n) - n
    return data[np.repeat(first - edge, n) + np.arange(int(n.sum()))]


class PackedTable:
    """word -> packed value in arrays, for many words at once, of ``bound`` bytes at most, about: 30 bytes beside
    a word and its value, where a dict of bytes takes 150. Words are found by a 64-bit hash and compared
    byte by byte; of two that share a hash one is held. Beyond the bound the words that were asked for
    least recently go, half of the bytes. Words over ``LONGEST_KEY`` aren't kept."""

    ENTRY_BYTES = 30  # two edges, the last use, the hash and its row

    def __init__(self, bound: int = CACHE_BYTES):
        self.bound = bound
        self.clear()

    def clear(self) -> None:
        self.words, self.word_at = np.zeros(0, np.uint8), np.zeros(1, np.uint32)
        self.values, self.value_at = np.zeros(0, np.uint8), np.zeros(1, np.uint32)
        self.used, self.now = np.zeros(0, np.int64), 0
        self.hashes, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # in the order of the hashes

    @property
    def held(self) -> int:
        return len(self.words) + len(self.values) + self.ENTRY_BYTES * len(self.rows)

    def __len__(self) -> int:
        return len(self.rows)

    def __iter__(self) -> Iterator[bytes]:
        return (self.words[a:b].tobytes() for a, b in zip(self.word_at.tolist(), self.word_at[1:].tolist()))

    def __contains__(self, word: bytes) -> bool:
        return self.find([word])[0] is not None

    @staticmethod
    def _hashes(data: np.ndarray, edge: np.ndarray) -> np.ndarray:
        n = np.diff(edge)
        order = np.argsort(-n, kind="stable")
        first, n = edge[:-1][order], n[order]
        out = n.astype(np.uint64)
        alive = len(n)
        for k in range(min(int(n[0]), LONGEST_KEY) if alive else 0):  # the k-th byte of all words that have one
            alive = int(np.searchsorted(-n, -k, "left"))
            out[:alive] = (out[:alive] ^ data[first[:alive] + k]) * _U(0x9E3779B97F4A7C15)
            out[:alive] ^= out[:alive] >> _U(29)
        back = np.empty(len(out), np.uint64)
        back[order] = mixed(out)
        return back

    def find(self, words: list[bytes]) -> list:
        """The values held for words, or None."""
        out: list = [None] * len(words)
        if not len(self.rows) or not words:
            return out
        data, edge = flat(words)
        hashes = self._hashes(data, edge)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        n = np.diff(edge)
        row = self.rows[place]
        first, size = self.word_at[row].astype(np.int64), (self.word_at[row + 1] - self.word_at[row]).astype(np.int64)
        at = np.flatnonzero((self.hashes[place] == hashes) & (size == n))
        apart = gather(data, edge[:-1][at], n[at]) != gather(self.words, first[at], n[at])
        if apart.any():
            at = at[np.bincount(np.repeat(np.arange(len(at)), n[at])[apart], minlength=len(at)) == 0]
        row = row[at]
        self.now += 1
        self.used[row] = self.now
        values = self.values.tobytes()
        for k, a, b in zip(at.tolist(), self.value_at[row].tolist(), self.value_at[row + 1].tolist()):
            out[k] = values[a:b]
        return out

    def keep_all(self, words: list[bytes], values: list[bytes], new: list[int] | None = None) -> None:
        """Different words, with their values; ``new``: the places of those that ``find`` didn't know. Words held stay."""
        some = [k for k in (range(len(words)) if new is None else new) if len(words[k]) <= LONGEST_KEY]
        if not some:
            return
        words, values = [words[k] for k in some], [values[k] for k in some]
        hashes = self._hashes(*flat(words))
        hashes, first = np.unique(hashes, return_index=True)
        if len(self.hashes):
            place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            fresh = self.hashes[place] != hashes
            hashes, first = hashes[fresh], first[fresh]
        n = len(self.used)
        for name, own in (("word", words), ("value", values)):
            data, edge = flat([own[k] for k in first.tolist()])
            at = getattr(self, f"{name}_at")
            setattr(self, f"{name}_at", np.concatenate([at, (edge[1:] + int(at[-1])).astype(np.uint32)]))
            setattr(self, f"{name}s", np.concatenate([getattr(self, f"{name}s"), data]))
        self.used = np.concatenate([self.used, np.full(len(first), self.now)])
        place = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, place, hashes)
        self.rows = np.insert(self.rows, place, np.arange(n, n + len(first), dtype=np.int32))
        self.turn()

    def turn(self) -> None:
        """Beyond the bound, only the words asked for last stay."""
        if self.held <= self.bound:
            return
        sizes = [np.diff(self.word_at).astype(np.int64), np.diff(self.value_at).astype(np.int64)]
        order = np.argsort(-self.used, kind="stable")
        stay = np.zeros(len(order), bool)
        stay[order[np.cumsum((sizes[0] + sizes[1] + self.ENTRY_BYTES)[order]) <= self.bound // 2]] = True
        for name, n in zip(("word", "value"), sizes):
            data = getattr(self, f"{name}s")[np.repeat(stay, n)]
            edge = np.concatenate([[0], np.cumsum(n[stay])]).astype(np.uint32)
            setattr(self, f"{name}s", data)
            setattr(self, f"{name}_at", edge)
        self.used = self.used[stay]
        row = (np.cumsum(stay) - 1).astype(np.int32)
        ok = stay[self.rows]
        self.hashes, self.rows = self.hashes[ok], row[self.rows[ok]]


_TABLES: dict[str, Callable[[], object]] = {}


def claim(name: str, clear: Callable[[], object]) -> None:
    """The task that calls this uses the worker's tables of operator ``name``, which ``clear`` empties.
    Those of other operators, whose tasks the worker ran before, go: a worker serves many jobs."""
    others = [other for other in _TABLES if other != name]
    for other in others:
        _TABLES.pop(other)()
    _TABLES[name] = clear
    if others:
        give_back()


def lean(run):
    """A task's function that keeps no tables: those of other operators go before, and unused memory
    goes back after."""
    def held(batches):
        claim("", lambda: None)
        yield from run(batches)
        give_back()

    return held


def give_back() -> None:
    """Unused memory of the worker goes back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not there with every C library
        pass


#: ASCII upper to lower case, every other byte as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The same, and every byte outside 0-9, a-z and non-ASCII becomes a blank.
LOWER_ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def blank_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased."""
    return text.translate(LOWER).split()


def alnum_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text.translate(LOWER_ALNUM).split()


def id_crc32(column: str = "doc_id"):
    """crc32 of an id written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


# ---- hashed words of many texts at once -------------------------------------------

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
#: A random number for each byte, none for blanks; the base of the polynomial, odd, and its inverse mod 2^64.
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_BYTE[[9, 10, 11, 12, 13, 32]] = 0
_BASE = int(_RNG.integers(1, 2**64, dtype=np.uint64)) | 1
_ODD = _RNG.integers(1, 2**64, 64, dtype=np.uint64) | _U(1)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_A_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_powers: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads each bit over all."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for ``n`` places at least."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.cumprod(np.concatenate([[_U(1)], np.full(max(n, HASH_BYTES) - 1, _U(b))]), dtype=np.uint64)
                      for b in (_BASE, pow(_BASE, -1, 2**64))]
    return _powers[0], _powers[1]


def blank_word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (``blank_words``) of the texts in a row, and where
    each text's begin, with the end. A word's hash is a polynomial over its bytes modulo
    2^64, mixed: the difference of two running sums."""
    data = b"\n".join(texts).translate(LOWER) + b"\n"
    cuts = np.cumsum([0] + [len(t) + 1 for t in texts])
    parts, starts_of = [], []
    at = 0
    while at < len(data):
        end = min(at + HASH_BYTES, len(data))
        if not _BLANK[data[end - 1]]:  # not inside a word; the data end in a blank
            end = _A_BLANK.search(data, end).end()
        b = np.frombuffer(data, np.uint8, end - at, at)
        word = ~_BLANK[b]
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        edge = np.concatenate([[0], edge]) if word[0] else edge  # every part ends in a blank
        power, inverse = _powers_of(len(b))
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTE[b] * power[:len(b)], out=total[1:])
        first, last = edge[::2], edge[1::2]
        parts.append(mixed((total[last] - total[first]) * inverse[first]))
        starts_of.append(first + at)
        at = end
    hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return hashes, np.searchsorted(np.concatenate(starts_of) if starts_of else np.zeros(0, int), cuts)


def shingles(texts: list[bytes], n: int = 5) -> list[np.ndarray]:
    """Each text's set of hashed ``n``-word shingles, ascending; with fewer words the
    whole sequence is one; without words the set is empty."""
    hashes, at = blank_word_hashes(texts)
    m = max(len(hashes) - n + 1, 0)
    runs = np.full(m, _U(n))
    for k in range(n):
        runs += hashes[k:k + m] * _ODD[k]
    runs = mixed(runs)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= n:
            own = np.sort(runs[a:b - n + 1])
            keep = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif b > a:
            few = _U(b - a) + (hashes[a:b] * _ODD[:b - a]).sum(dtype=np.uint64)
            out.append(mixed(np.array([few], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


# ---- ids as a bounded bitmap -------------------------------------------------------


class IdFilter:
    """A bitmap over hashed ids: says yes to every id put in and to few others. It has 16
    places per id, ``MOST_BITS`` at most, so it can be broadcast at any size of the input;
    beyond that bound it only says yes more often. Use it to leave out work, not rows of
    a result."""

    MOST_BITS = 1 << 29

    def __init__(self, bits: int, parts: list[bytes]):
        self.bits = bits
        self.map = np.frombuffer(b"".join(parts), np.uint8)

    @staticmethod
    def place(ids: np.ndarray, bits: int) -> np.ndarray:
        return (mixed(ids.astype(np.uint64) + _U(1)) & _U(bits - 1)).astype(np.int64)

    def has(self, ids: np.ndarray) -> np.ndarray:
        at = self.place(ids, self.bits)
        return (self.map[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    @classmethod
    def of(cls, ids: DataFrame) -> IdFilter:
        """From a one-column DataFrame of longs. Pieces of the bitmap are made by tasks;
        only they come to the driver."""
        name = ids.columns[0]
        with tidy(ids.sparkSession):
            n = ids.count()
        bits = min(cls.MOST_BITS, max(1 << 16, 1 << (16 * max(n, 1) - 1).bit_length()))
        width = min(bits, 1 << 22)
        place = cls.place

        def places(batches):
            for b in batches:
                at = np.unique(place(b.column(0).to_numpy(zero_copy_only=False), bits))
                yield pa.RecordBatch.from_arrays([pa.array((at // width).astype(np.int32)), pa.array(at % width)], ["piece", "at"])

        def maps(batches):
            at, own = None, None
            for b in batches:
                piece, place_ = b.column(0).to_numpy(), b.column(1).to_numpy()
                for p in np.unique(piece).tolist():  # rows are in the order of the pieces
                    if p != at:
                        if own is not None:
                            yield cls._row(at, own)
                        at, own = p, np.zeros(width, bool)
                    own[place_[piece == p]] = True
            if own is not None:
                yield cls._row(at, own)

        found = ids.where(F.col(name).isNotNull()).mapInArrow(places, "piece int, at long").repartition("piece").sortWithinPartitions("piece")
        out = np.zeros((bits // width, width // 8), np.uint8)
        with tidy(ids.sparkSession):
            rows = found.mapInArrow(maps, "piece int, map binary").collect()  # MOST_BITS in all
        for r in rows:
            out[r["piece"]] |= np.frombuffer(bytes(r["map"]), np.uint8)
        return cls(bits, [out.tobytes()])

    @staticmethod
    def _row(piece: int, own: np.ndarray) -> pa.RecordBatch:
        bits = np.packbits(own, bitorder="little").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([bits], pa.binary())], ["piece", "map"])
