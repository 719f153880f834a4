"""Language ID by string kernels: blended-spectrum presence kernels with Nystrom
landmarks and one-versus-rest kernel ridge regression.

A text (A-Z lower-cased, every other ASCII character that is no letter a blank) is the
set of its byte n-grams of 2 to 4 bytes, hashed to ``FEATURES`` places; the kernel of
two texts is the size of their sets' intersection over the geometric mean of their
sizes. ``LANDMARKS`` labelled texts stand for the kernel's space: a text's kernel
values against them, times the whitened ridge coefficients, are its scores by
language, and a batch of texts is scored by two matrix products.

The model is fitted on about ``TRAIN_ROWS`` labelled rows, shared evenly among the
languages and chosen by a hash of the doc_id; landmarks are the first of each language.
Whole texts are read, in windows of a megabyte.

A null text, or one without a letter, is ``und`` with score 0. Null languages are not
learned from. Equal texts get equal results; a tie goes to the language first in
code point order. With no labelled row everything is ``und``. An empty table gives no
rows. Other columns are ignored, or kept by ``keep_known``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.llm.common import id_crc32, lean, pieces, ship

FEATURES = 1 << 14
LANDMARKS = 128
TRAIN_ROWS = 2400
#: Buckets of ids from each of which the same number of rows of a language is taken.
TRAIN_BUCKETS = 64
RIDGE = 1e-3
#: Sharpness of the scores' softmax.
SHARP = 6.0
#: ``keep_known`` keeps a document whose best language has at least this score.
LEAST_SCORE = 0.3
UNDETERMINED = "und"
BATCH = 128
_STEP = 1 << 20
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_ODD = {2: np.uint32(2654435761), 3: np.uint32(2246822519), 4: np.uint32(3266489917)}
_SHIFT = np.uint32(32 - 14)


def mark(text: bytes, row: np.ndarray) -> None:
    """Set the places of the text's n-grams in ``row``."""
    clean = text.translate(_TABLE)
    for at in range(0, max(len(clean), 1), _STEP):
        b = np.frombuffer(clean[at:at + _STEP + 3], np.uint8).astype(np.uint32)
        gram = b
        for n in (2, 3, 4):
            if len(b) < n:
                break
            gram = (gram[:-1] << np.uint32(8)) | b[n - 1:]
            row[(gram * _ODD[n]) >> _SHIFT] = 1


def has_letter(text: bytes) -> bool:
    if text.translate(None, _NO_LETTERS):
        return True
    return not text.isascii() and any(c.isalpha() for c in text.decode())


_NO_LETTERS = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122))


@dataclass(frozen=True)
class Model:
    """Languages, landmark sets (features x landmarks, scaled) and coefficients."""

    languages: list[str]
    landmarks: np.ndarray
    coefficients: np.ndarray

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """Best language and its score, for a batch of texts with letters."""
        values = kernel(presence(texts), self.landmarks) @ self.coefficients
        best = values.argmax(axis=1)
        sharp = np.exp(SHARP * (values - values.max(axis=1, keepdims=True)))
        return [self.languages[k] for k in best], 1.0 / sharp.sum(axis=1)


def presence(texts: list[bytes]) -> np.ndarray:
    out = np.zeros((len(texts), FEATURES), np.float32)
    for row, text in zip(out, texts):
        mark(text, row)
    return out


def kernel(sets: np.ndarray, scaled_landmarks: np.ndarray) -> np.ndarray:
    """Normalised intersections with the landmarks."""
    size = np.sqrt(np.maximum(sets.sum(axis=1), 1.0))
    return (sets @ scaled_landmarks) / size[:, None]


def fit(rows: list[tuple[str, bytes]]) -> Model:
    """A model from (language, text) rows."""
    return fit_marks([lang for lang, _ in rows], presence([t for _, t in rows]))


def fit_marks(langs: list[str], marks: np.ndarray) -> Model:
    """Ridge regression of +1 / -1 by language on whitened landmark kernels, from presence rows. The
    first rows of each language are the landmarks."""
    languages = sorted(set(langs))
    code = np.array([languages.index(lang) for lang in langs])
    share = max(1, LANDMARKS // max(1, len(languages)))
    first = np.concatenate([np.flatnonzero(code == k)[:share] for k in range(len(languages))])
    scaled = (marks[first] / np.sqrt(np.maximum(marks[first].sum(axis=1), 1.0))[:, None]).T.astype(np.float32).copy()
    own = kernel(marks[first], scaled).astype(np.float64)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    whiten = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    gram, right = np.zeros_like(own), np.zeros((len(own), len(languages)))
    target = np.where(code[:, None] == np.arange(len(languages)), 1.0, -1.0)
    weight = 1.0 / np.bincount(code)[code][:, None]
    for at in range(0, len(code), BATCH):
        part = slice(at, at + BATCH)
        phi = kernel(marks[part], scaled) @ whiten
        gram += phi.T @ (phi * weight[part])
        right += phi.T @ (target[part] * weight[part])
    coefficients = whiten @ np.linalg.solve(gram + RIDGE * np.eye(len(gram)), right)
    return Model(languages, scaled, coefficients.astype(np.float32))


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model | None:
    """A model from labelled rows of ``docs`` (doc_id, text, lang), about ``train_rows`` of them, shared
    among the languages: in each of ``TRAIN_BUCKETS`` buckets of ids those with the smallest hashes, so
    no task orders all rows of a language. Ids are chosen from two narrow columns; the
    texts become presence rows in the tasks, and only these bits come to the driver."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    own = F.col("doc_id").cast("long")
    named = known.select(own.alias("id"), F.col("lang").cast("string").alias("label"), F.pmod(F.xxhash64(own, F.lit(1)), F.lit(TRAIN_BUCKETS)).alias("bucket"))
    n_langs = named.select("label").distinct().count()
    if not n_langs:
        return None
    each = max(1, -(-train_rows // (n_langs * TRAIN_BUCKETS)))
    turn = Window.partitionBy("label", "bucket").orderBy(F.xxhash64("id"), "id")
    chosen = named.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= each).select("id").distinct()
    texts = known.select(own.alias("id"), F.col("lang").cast("string").alias("label"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(chosen), "id")  # TRAIN_BUCKETS * each for a language

    def marked(batches):
        for batch in batches:
            for piece, own_texts in pieces(batch, "text"):
                rows = [k for k, t in enumerate(own_texts) if has_letter(t)]
                bits = [np.packbits(presence([own_texts[k]])[0] > 0).tobytes() for k in rows]
                digest = [hashlib.blake2b(own_texts[k], digest_size=8).digest() for k in rows]
                some = piece.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([some.column("id"), some.column("label"), pa.array(digest, pa.binary()), pa.array(bits, pa.binary())],
                                                 ["id", "label", "digest", "bits"])

    marks = found.mapInArrow(lean(marked), "id long, label string, digest binary, bits binary")
    # rows that repeat an id are few or many: as many rows as were asked for, in the order of hashes
    got = marks.orderBy(F.xxhash64("id"), "id", "label", "digest").limit(2 * TRAIN_BUCKETS * each * n_langs).collect()
    if not got:
        return None
    return fit_marks([r["label"] for r in got], np.stack([np.unpackbits(np.frombuffer(r["bits"], np.uint8))[:FEATURES] for r in got]).astype(np.float32))


def _score(docs: DataFrame, model: Model | None, schema, emit) -> DataFrame:
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            for piece, texts in pieces(batch, "text"):
                langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
                rows = [k for k, t in enumerate(texts) if own and has_letter(t)]
                for at in range(0, len(rows), BATCH):
                    part = rows[at:at + BATCH]
                    best, score = own.predict([texts[k] for k in part])
                    for k, lang, s in zip(part, best, score.tolist()):
                        langs[k], scores[k] = lang, s
                yield emit(piece, langs, scores)

    return docs.mapInArrow(lean(run), schema)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of each row."""
    def emit(piece, langs, scores):
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(langs), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return _score(rows, model, "doc_id long, lang_pred string, score double", emit)


def labelled(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from: crc32(doc_id) mod 4 is not 2."""
    return docs.where(F.pmod(id_crc32(), F.lit(4)) != 2)


def keep_known(docs: DataFrame, model: Model | None, least: float = LEAST_SCORE) -> DataFrame:
    """``docs`` without rows that are ``und`` or whose best score is under ``least``."""
    def emit(piece, langs, scores):
        ok = [lang != UNDETERMINED and s >= least for lang, s in zip(langs, scores)]
        return piece.filter(pa.array(ok, pa.bool_()))

    return _score(docs, model, docs.schema, emit)
