"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton over the pieces enumerates every piece that ends at each
character; dynamic programming over the ends carries, for the best segmentation so
far, its score and number of pieces, and nothing else: no back pointers and no pieces
are kept. The rules are those of the public Unigram tokenizer: scores add up in
doubles; at an end, matches are tried from the longest piece (earliest start) to the
shortest, and a later one wins only with a strictly greater score; a character that no
one-character piece covers may also be an unknown, scored ``min score - 10``; unknowns in a row are
one piece, written as one byte piece per UTF-8 byte where the vocabulary has all 256.

Blanks are written as the mark U+2581, which pieces hold at their start only
(``Vocabulary`` checks it), so a best segmentation never crosses from a non-blank to a
blank and a text is the sum of its chunks (a run of blanks and the word after it); the
chunks a worker has seen are remembered. Scores are sums of whole numbers in this
vocabulary, so the split changes no score and no tie. Runs of unknowns do not cross a
blank either, as the blank is a piece.

Null and empty texts have 0 tokens and score 0; the rows of a repeated document are
each returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import claim, pieces, ship, WordTable

MARK = "▁"
VOCABULARY = "piece_bpe_32k.model"
#: Bytes of the chunks that a worker remembers.
CACHE_BYTES = 128 << 20
UNKNOWN_PENALTY = 10.0
CHUNK = re.compile(" *[^ ]+| +$")
_PACKED = struct.Struct("<dq")


class Vocabulary:
    """Pieces and scores of a unigram model."""

    def __init__(self, scored: list[tuple[str, float]], byte_fallback: bool = True):
        self.scores = dict(scored)
        self.least = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in self.scores for b in range(256))
        if any(MARK in p.lstrip(MARK) for p in self.scores):
            raise ValueError("a piece holds a blank after another character")
        self.singles = {p for p in self.scores if len(p) == 1}
        self.found = ahocorasick.Automaton()
        for p, s in self.scores.items():
            if p:
                self.found.add_word(p, (len(p), s))
        if len(self.found):
            self.found.make_automaton()
        self.known = WordTable(self._chunk, bound=CACHE_BYTES)

    def _chunk(self, chunk: str) -> bytes:
        return _PACKED.pack(*self.best(chunk.replace(" ", MARK)))

    def best(self, text: str) -> tuple[float, int]:
        """Score and number of tokens of the best segmentation of marked text. The
        automaton gives matches by end, at each end the longest first."""
        n = len(text)
        score, count = [_NONE] * (n + 1), [0] * (n + 1)
        score[0] = 0.0
        matches = self.found.iter(text) if len(self.found) else ()
        if self.singles.issuperset(text):
            for end, (size, s) in matches:
                at = end + 1 - size
                got = score[at] + s
                if got > score[end + 1]:
                    score[end + 1] = got
                    count[end + 1] = count[at] + 1
            return score[n], count[n]
        unknown, done = [False] * (n + 1), 0

        def close(upto):  # ends before ``upto`` have all their matches: may they be unknown?
            for k in range(done, upto):
                if text[k] not in self.singles and score[k] + self.least > score[k + 1]:
                    one = len(text[k].encode()) if self.bytes else 0 if unknown[k] else 1
                    score[k + 1], count[k + 1], unknown[k + 1] = score[k] + self.least, count[k] + one, True

        for end, (size, s) in matches:
            if end > done:
                close(end)
                done = end
            at = end + 1 - size
            got = score[at] + s
            if got > score[end + 1]:
                score[end + 1], count[end + 1] = got, count[at] + 1
        close(n)
        return score[n], count[n]

    def count(self, text: str) -> tuple[float, int]:
        """Score and number of tokens of a whole text."""
        got = np.frombuffer(b"".join(map(self.known.__getitem__, CHUNK.findall(text))), _DTYPE)
        return float(got["score"].sum()), int(got["n"].sum())


_NONE = float("-inf")
_DTYPE = np.dtype([("score", "<f8"), ("n", "<i8")])


def model_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a public sentencepiece file, without its control pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return [(model.id_to_piece(i), model.get_score(i)) for i in ids if not (model.is_control(i) or model.is_unknown(i))]


@lru_cache(maxsize=2)
def worker_vocabulary(path: str) -> Vocabulary:
    """The worker's vocabulary, kept between tasks."""
    return Vocabulary(model_pieces(path))


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens and the best segmentation's score."""
    ship(docs.sparkSession)
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("unigram", worker_vocabulary.cache_clear)
        words = worker_vocabulary(path)
        for batch in batches:
            for piece, texts in pieces(batch, "text"):
                got = [words.count(t.decode()) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array([n for _, n in got], pa.int64()), pa.array([s for s, _ in got], pa.float64())],
                    ["doc_id", "n_tokens", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, score double")
