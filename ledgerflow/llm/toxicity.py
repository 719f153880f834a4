"""Toxicity of restored text.

Writers hide words by look-alike signs (``1d10t``), spacing (``i d i o t``, ``i.d.i.o.t``)
and repetition (``looooser``). A noisy channel undoes this: a token that shows such signs
becomes a lattice of what each sign may stand for, with the cost of each reading, and a
Viterbi decode under a character language model gives the likeliest letters. A sign, and
the blank between single letters, may also be the edge of a word, so the decode chooses the
cuts (``you/idiot``, ``a m o r o n``). Words of the restored text are then scored, each
token's letters between signs among them. A token without letters (``$#!7``) is read as
its look-alikes, if these are not all the same.

* Language model: 4-grams of letters within words, counted over all texts of the
  corpus, with smoothing towards shorter contexts. The table is bounded by the
  alphabet (28 signs), the counts grow with the corpus.
* Word weights: documents with and without each restored word among labelled rows, at
  most ``TRAIN_ROWS`` of each label, chosen by a hash of the doc_id. A word enters with
  at least ``LEAST_DOCS`` toxic documents, a share of ``LEAST_SHARE`` of them and a
  log-likelihood ratio of ``LEAST_RATIO``; the ``VOCABULARY`` strongest are kept.
* Score: a logistic curve over the summed weights of the distinct words in a text,
  fitted on the same rows.

Null and empty texts have no words and get the curve's value at 0. Labels without a
document, with a null, or of documents outside ``learn_from`` teach nothing; a document
with both labels counts for each. With no toxic label all scores are 0. Equal texts get
equal scores; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.llm.common import id_crc32, lean, LOWER, pieces, ship, WordTable

TRAIN_ROWS = 10_000
SAMPLE_BUCKETS = 256
LEAST_DOCS = 5
LEAST_SHARE = 0.003
LEAST_RATIO = 30.0
VOCABULARY = 20_000
#: Bytes of the tokens that a worker remembers.
CACHE_BYTES = 96 << 20
#: Letters and their look-alikes.
LOOKS = {"4": "a", "@": "a", "8": "b", "(": "c", "3": "e", "6": "g", "9": "g", "#": "h", "1": "il", "!": "il",
         "|": "il", "0": "o", "5": "s", "$": "s", "7": "t", "+": "t", "2": "z"}
#: Costs in nats: a look-alike, a sign between letters that means nothing, a repetition undone,
#: signs that part two words.
LOOK_COST, NOISE_COST, REPEAT_COST, EDGE_COST = 1.5, 0.7, 0.4, 0.7
#: Signs of the language model: word edge, a-z, any other letter.
SIGNS = 28
ORDER = 4
_SIGN = {c: k for k, c in enumerate(" abcdefghijklmnopqrstuvwxyz")}
_CLASS = bytes(b - 64 if 65 <= b <= 90 else b - 96 if 97 <= b <= 122 else 27 if b >= 0xC2 else 0 for b in range(256))
_TAIL = bytes(range(0x80, 0xC2))
_EDGE = b"".join(bytes([b]) for b in range(33, 128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
_PUNCTUATION = "!()[]{}\"'.,:;?"
#: Marks of a packed number: the token is a single letter; the number goes on with the token before.
_SINGLE, _MORE = 1 << 31, 1 << 30


# ---- language model ---------------------------------------------------------------


def gram_counts(docs: DataFrame) -> DataFrame:
    """(gram, n): 4-grams of signs over all texts; runs of other characters are one edge."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIGNS**ORDER, np.int64)
        for batch in batches:
            for _, texts in pieces(batch, "text"):
                a = np.frombuffer(b"\n\n\n".join([b"", *texts, b""]).translate(_CLASS, _TAIL), np.uint8).astype(np.int32)
                edge = a == 0
                a = np.concatenate([[0, 0], a[~(edge & np.concatenate([[True], edge[:-1]]))]])
                code = ((a[:-3] * SIGNS + a[1:-2]) * SIGNS + a[2:-1]) * SIGNS + a[3:]
                total += np.bincount(code, minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], ["gram", "n"])

    return docs.select(F.col("text").cast("string")).mapInArrow(lean(run), "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def log_probabilities(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """log p(sign | three before) for every 4-gram, smoothed towards shorter contexts."""
    full = np.zeros(SIGNS**ORDER)
    full[grams] = counts
    full = full.reshape((SIGNS,) * ORDER)
    p = np.full(SIGNS, 1.0 / SIGNS)
    for order in range(1, ORDER + 1):
        seen = full.sum(axis=tuple(range(ORDER - order))) if order < ORDER else full
        p = (seen + 4.0 * p) / (seen.sum(axis=-1, keepdims=True) + 4.0)
    return np.log(p).astype(np.float32).reshape(-1)


# ---- noisy channel ----------------------------------------------------------------


def readings(token: str, cuts: bool = False, letterless: bool = False) -> list[list[tuple[str, float]]]:
    """The lattice: for each run of equal signs what it may be read as, at what cost. With
    ``cuts`` signs may part words, as a blank; of a ``letterless`` token all look-alikes are
    letters."""
    out, at = [], 0
    while at < len(token):
        end = at
        while end < len(token) and token[end] == token[at]:
            end += 1
        c, n = token[at], end - at
        if c.isalpha():
            ways = [(c * n, 0.0)] if n < 3 else [(c, REPEAT_COST), (c + c, REPEAT_COST)]
        else:
            looks = LOOKS.get(c, "")
            ways = [] if letterless and looks else [("", NOISE_COST * n)] + [(" ", EDGE_COST)] * cuts
            for letter in looks:
                ways += [(letter, LOOK_COST + REPEAT_COST * (n > 1))] + ([(letter * 2, 2 * LOOK_COST)] if n > 1 else [])
        out.append(ways)
        at = end
    return out


def spaced_readings(letters: list[str]) -> list[list[tuple[str, float]]]:
    """The lattice of single letters with blanks between them, each of which may part words
    or mean nothing."""
    out = []
    for k, c in enumerate(letters):
        if k:
            out.append([("", 0.0), (" ", 0.0)])
        ways = [(c, 0.0)] if c.isalpha() else [(x, LOOK_COST) for x in LOOKS.get(c, "")] or [("", NOISE_COST)]
        # of three or more alike, each but the first may be a repetition
        if k and letters[k - 1] == c and (letters[k - 2:k - 1] == [c] or letters[k + 1:k + 2] == [c]):
            ways = [*ways, ("", REPEAT_COST)]
        out.append(ways)
    return out


def likeliest(lattice: list[list[tuple[str, float]]], model: np.ndarray) -> str:
    """The likeliest letters of a lattice: Viterbi, a state for the last three signs."""
    states: dict = {(0, 0, 0): (0.0, None)}
    for ways in lattice:
        new: dict = {}
        for context, (score, text) in states.items():
            for letters, cost in ways:
                s, own = score - cost, context
                for c in letters:
                    k = _SIGN.get(c, 27)
                    s += model[((own[0] * SIGNS + own[1]) * SIGNS + own[2]) * SIGNS + k]
                    own = (own[1], own[2], k) if k else (0, 0, 0)  # words follow each other freely
                if own not in new or s > new[own][0]:
                    new[own] = s, (text, letters) if letters else text
        states = new
    ends = ((s + model[((c[0] * SIGNS + c[1]) * SIGNS + c[2]) * SIGNS], t) for c, (s, t) in states.items())
    out, text = [], max(ends, key=lambda end: end[0])[1]
    while text:
        text, letters = text
        out.append(letters)
    return "".join(reversed(out))


def decode(token: str, model: np.ndarray) -> str:
    """The likeliest letters of a token as one word."""
    return likeliest(readings(token), model)


def decoded_words(token: str, model: np.ndarray) -> list[str]:
    """A disguised token as one word, and as the words it is likeliest cut into."""
    return [decode(token, model), *likeliest(readings(token, cuts=True), model).split()]


def disguised(core: str) -> bool:
    """Whether a token, without signs at its edges, shows letters hidden among signs or
    a letter three times in a row."""
    if not any(c.isalpha() for c in core):
        return False
    return not core.isalpha() or any(a == b == c for a, b, c in zip(core, core[1:], core[2:]))


def restored(token: bytes, model: np.ndarray) -> list[str]:
    """Words that a token stands for: itself without its edges; where it is disguised, the
    decoded letters of it with and without the signs at its edges, and its letters between
    signs, if two or more; without letters what its look-alikes spell."""
    core, left = token.strip(_EDGE).decode(), token.decode()
    found = [core] if core else []
    if not any(c.isalpha() for c in left):
        for t in {core, left, left.strip(_PUNCTUATION)}:
            if len({c for c in t if c in LOOKS}) > 1:
                found += likeliest(readings(t, cuts=True, letterless=True), model).split()
        return found
    if core and disguised(core):
        found += decoded_words(core, model)
        parts = "".join(c if c.isalpha() else " " for c in core).split()
        found += [p for p in parts if p != core and (len(p) > 1 or not p.isascii())]
    if left != core and any(c in LOOKS for c in (left[:1], left[-1:])):
        found += decoded_words(left, model)
    return found


def lone(token: bytes) -> bool:
    """Whether a token is a single letter or look-alike, without signs at its edges."""
    core = token.strip(_EDGE)
    return len(core) == 1 or (len(token) == 1 and chr(token[0]) in LOOKS)


@dataclass
class Scorer:
    """Words to weight places, with what a worker remembers of tokens."""

    model: np.ndarray
    places: dict[str, int] | None = None
    known: WordTable = field(init=False)

    def __post_init__(self):
        self.known = WordTable(self._pack, bound=CACHE_BYTES)

    def _pack(self, token: bytes) -> bytes:
        single = _SINGLE if lone(token) else 0
        first, *more = sorted({self.places.get(w, 0) for w in restored(token, self.model)} - {0}) or [0]
        return struct.pack(f"<{1 + len(more)}I", first | single, *(place | _MORE for place in more))

    def words(self, text: bytes) -> set[str]:
        """Distinct restored words of a text."""
        tokens = text.translate(LOWER).split()
        out = {w for t in set(tokens) for w in restored(t, self.model)}
        single = np.array([lone(t) for t in tokens], bool)
        return out | set(self.spaced(tokens, single))

    def spaced(self, tokens: list[bytes], single: np.ndarray) -> Iterator[str]:
        """Words of decoded runs of three or more single letters, each run also as one word.
        Runs that repeat one letter say nothing."""
        edges = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= 3 and len(set(run := tokens[a:b])) > 1:
                letters = [(t.strip(_EDGE) or t).decode() for t in run]
                yield decode("".join(letters), self.model)
                yield from likeliest(spaced_readings(letters), self.model).split()

    def found(self, text: bytes) -> np.ndarray:
        """Places of the weighted words in a text, each once."""
        tokens = text.translate(LOWER).split()
        packed = np.frombuffer(b"".join(map(self.known.__getitem__, tokens)), "<u4")
        places = np.unique(packed & (_MORE - 1))
        single = packed[packed & _MORE == 0] >= _SINGLE  # one for each token
        if single.sum() >= 3:
            more = [self.places.get(w, 0) for w in self.spaced(tokens, single)]
            places = np.union1d(places, np.array(more, places.dtype))
        return places[places > 0]


# ---- training ---------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    letters: np.ndarray
    words: dict[str, int]
    weights: np.ndarray
    slope: float
    base: float

    def score(self, total: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(self.slope * total + self.base)))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` labelled documents of each label: toxic, text."""
    named = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    named = named.join(docs.where("text is not null").select(F.col("doc_id").cast("long").alias("id")).distinct(), "id", "left_semi")
    # as many from each of the hash's buckets, so that no task orders all rows of a label
    bucket = F.pmod(F.xxhash64("id"), F.lit(SAMPLE_BUCKETS))
    turn = Window.partitionBy("toxic", bucket).orderBy(F.xxhash64("id", F.lit(1)), "id")
    most = max(1, rows // SAMPLE_BUCKETS)
    chosen = named.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= most).select("id", "toxic")
    own = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return own.join(F.broadcast(chosen), "id").select("toxic", "text")  # at most 2 * rows ids


def word_documents(rows: DataFrame, letters) -> DataFrame:
    """(word, toxic_docs, clean_docs) over the training rows."""
    def run(batches):
        scorer = Scorer(letters.value)
        for batch in batches:
            for piece, texts in pieces(batch, "text"):
                counts = Counter(), Counter()
                for toxic, text in zip(piece.column("toxic").to_pylist(), texts):
                    counts[1 - toxic].update(scorer.words(text))
                words = list(counts[0] | counts[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in counts)],
                    ["word", "toxic_docs", "clean_docs"])

    found = rows.mapInArrow(lean(run), "word string, toxic_docs long, clean_docs long")
    return found.groupBy("word").agg(F.sum("toxic_docs").alias("toxic_docs"), F.sum("clean_docs").alias("clean_docs"))


def word_weights(words: DataFrame, n_toxic: int, n_clean: int) -> tuple[dict[str, int], np.ndarray]:
    """Words that speak for toxicity, by log-likelihood ratio, and their log odds."""
    a, b = F.col("toxic_docs"), F.col("clean_docs")
    odds = F.log((a + 0.5) / (n_toxic + 1.0)) - F.log((b + 0.5) / (n_clean + 1.0))
    n = n_toxic + n_clean
    share = (a + b) / F.lit(float(n))
    part = lambda seen, of: F.when(seen > 0, seen * F.log(seen / (of * share))).otherwise(0.0)
    ratio = 2 * (part(a, F.lit(float(n_toxic))) + part(b, F.lit(float(n_clean))))
    strong = words.where((a >= LEAST_DOCS) & (a >= LEAST_SHARE * n_toxic)).select("word", odds.alias("odds"), ratio.alias("ratio")).where(
        (F.col("odds") > 1) & (F.col("ratio") >= LEAST_RATIO))
    top = strong.orderBy(F.desc("ratio"), "word").limit(VOCABULARY).collect()
    return {r["word"]: k + 1 for k, r in enumerate(top)}, np.array([0.0, *(r["odds"] for r in top)])


def fit_curve(totals: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and base of a logistic curve, by Newton steps with a small ridge; the labels
    weigh alike in sum."""
    x = np.stack([totals, np.ones_like(totals)], axis=1)
    w, ridge = np.zeros(2), np.diag([1e-2, 1e-4])
    weight = np.where(toxic == 1, 0.5 / max(1, (toxic == 1).sum()), 0.5 / max(1, (toxic == 0).sum())) * len(toxic)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - toxic)) + ridge @ w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        w = w - np.linalg.solve(hess, grad)
    return float(w[0]), float(w[1])


def train(docs: DataFrame, labels: DataFrame, learn_from=None, rows: int = TRAIN_ROWS) -> Model:
    """Language model over all of ``docs``; words and curve over labelled rows where
    ``learn_from`` (a column over doc_id) holds."""
    context = docs.sparkSession.sparkContext
    grams = gram_counts(docs).toPandas()  # at most SIGNS ** ORDER rows
    letters = log_probabilities(grams["gram"].to_numpy(), grams["n"].to_numpy())
    held = context.broadcast(letters)
    pool = docs if learn_from is None else docs.where(learn_from)
    chosen = training_rows(pool, labels, rows)
    sizes = {r["toxic"]: r["n"] for r in chosen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1):
        return Model(letters, {}, np.zeros(1), 0.0, -60.0)
    places, weights = word_weights(word_documents(chosen, held), sizes[1], sizes.get(0, 0))
    first = Model(letters, places, weights, 1.0, 0.0)
    got = _totals(chosen, first, "toxic int", ["toxic"]).toPandas()  # two numbers for each training row
    slope, base = fit_curve(got["total"].to_numpy(), got["toxic"].to_numpy())
    return Model(letters, places, weights, slope, base)


def _totals(rows: DataFrame, model: Model, schema: str, keep: list[str]) -> DataFrame:
    """``keep`` and the summed weights of each row's distinct words."""
    ship(rows.sparkSession)
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = held.value
        scorer = Scorer(own.letters, own.words)
        for batch in batches:
            for piece, texts in pieces(batch, "text"):
                totals = [float(own.weights[scorer.found(t)].sum()) for t in texts]
                yield pa.RecordBatch.from_arrays([*map(piece.column, keep), pa.array(totals, pa.float64())], [*keep, "total"])

    return rows.mapInArrow(lean(run), f"{schema}, total double")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    value = 1.0 / (1.0 + F.exp(-(F.col("total") * model.slope + model.base)))
    return _totals(rows, model, "doc_id long", ["doc_id"]).select("doc_id", value.alias("score"))


def fifth(column: str = "doc_id"):
    """crc32 of the id as text, mod 5."""
    return F.pmod(id_crc32(column), F.lit(5))
