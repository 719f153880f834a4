"""Token-ID / binary output with directly addressable codes.

Token ids are written in segments. A segment splits each id into chunks of
``CHUNK_BITS`` bits: level 0 holds the lowest chunk of every id, level k the next
chunk of those ids that still have bits left. A level carries its chunks, a bitmap
that says which of its entries continue on the next level, and a rank directory
(set bits before each block of ``RANK_BLOCK`` entries). Token i is read by
following i -> rank(i) -> ... through the levels, with no block to decode before.

Layout of a segment, all numbers little-endian::

    magic "DAC1" | u32 chunk bits | u32 levels | u32 rank block
    u64 documents | u64 ids | u64 ids before this segment in its range
    i64 doc_id per document | u8 null flag per document | u64 first id per document, and the end
    per level: u64 entries | chunks (u8) | continuation bitmap | u32 rank directory

Segments are rows ``(range, seq, n_ids, segment)`` of a Parquet table, written by
Spark's own committer: any storage, whole files or none when a task is lost.
``range`` numbers ascending doc_id ranges and ``seq`` the segments in one, so
reading in (range, seq) order is ascending doc_id order.

Null and empty texts have no ids but the end id; a null doc_id sorts first; rows
that share a doc_id are each written, in the order of a hash of their texts; an
empty table gives no segments and no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.llm.common import LOWER, PackedTable, PIECE_BYTES, WordTable, claim, give_back, pieces, ship, stored

MAGIC = b"DAC1"
CHUNK_BITS = 8
RANK_BLOCK = 512
#: Ids after which a segment is closed: about 2.3 bytes each.
SEGMENT_IDS = 2_000_000
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Bytes of the chunks between blanks, and of their cores, that a worker remembers with their ids.
CHUNK_TABLE, CORE_TABLE = 40 << 20, 12 << 20
END_OF_WORD = "</w>"
WORDS_AT_ONCE = 500
#: ASCII signs that are neither letters, digits nor blanks.
SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
#: How special tokens begin.
SPECIAL = b"<|"
BLANKS = b" \t\n\r\x0b\x0c"
_BLANK = re.compile(b"[ \t\n\r\x0b\x0c]")
_HARD = 4
#: Kinds of bytes: blank, letter, digit, sign, and those that keep their chunk whole.
_KIND = bytes(0 if b in BLANKS else _HARD if b < 32 or b > 126 or b == 39 else 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 for b in range(256))
SEGMENT_SCHEMA = "range int, seq int, n_ids long, segment binary"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Texts to ids. Blanks (ASCII white space) are dropped by this tokenizer and
    nothing it does looks across them (``splits_on_blanks`` checks the file), so a
    text's ids are those of its chunks in a row; chunks are remembered as packed
    u32. A file that keeps white space is applied to whole texts.

    A text is cut into units by its bytes, all at once: within a chunk without bytes over 127,
    apostrophes (contractions) or control signs, runs of letters, of digits and of signs are
    units, as the tokenizer parts there; other chunks are units as they are. Each different unit is
    looked up once a batch, and the ids of all are gathered by their numbers.

    A new unit is its core and the ASCII signs after it, which the tokenizer parts in
    the same place if the core ends in a letter or digit and there is no apostrophe. Cores
    of letters are one word each, as a rule; many are encoded at once, a blank between, and
    told apart by the tokens that end a word. Those of small ASCII letters are the model's words as
    they stand, so only blanks part them (``plain``). A text with a special token's sign is applied whole."""

    def __init__(self, path: str):
        from tokenizers import pre_tokenizers, Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        if hasattr(self.tokenizer.model, "_resize_cache"):  # words come once, so the model needn't remember them, too
            self.tokenizer.model._resize_cache(0)
        self.by_chunk = splits_on_blanks(path)
        self.known: PackedTable | WordTable = PackedTable(CHUNK_TABLE)
        self.cores: PackedTable | WordTable = PackedTable(CORE_TABLE)
        self.plain = self.tokenizer
        if small_letters_stay(path):
            self.plain = Tokenizer(self.tokenizer.model)
            self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        # then every word has a token that ends it, so as many ends as words are one for each
        self.always_ends = all(b + END_OF_WORD in vocabulary for b in pre_tokenizers.ByteLevel.alphabet())
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[k for t, k in vocabulary.items() if t.endswith(END_OF_WORD)]] = True

    def encode(self, texts: list[str], plain: bool = False) -> list[np.ndarray]:
        tokenizer = self.plain if plain else self.tokenizer
        return [np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def word_ids(self, words: list[bytes], plain: bool) -> dict[bytes, bytes]:
        """Ids of words of letters, ``WORDS_AT_ONCE`` in a call. ``plain``: all are of small ASCII letters."""
        out = {}
        groups = [words[at:at + WORDS_AT_ONCE] for at in range(0, len(words), WORDS_AT_ONCE)]
        for group, ids in zip(groups, self.encode([b" ".join(g).decode() for g in groups], plain)):
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(group):
                data, at = ids.tobytes(), 0
                for word, end in zip(group, (4 * cut).tolist()):
                    out[word] = data[at:end]
                    at = end
            else:
                out.update((w, i.tobytes()) for w, i in zip(group, self.encode([w.decode() for w in group])))
        return out

    def learn(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """Ids of new chunks, all in small ASCII letters."""
        have = self.word_ids([c for c in chunks if c.isalpha()], True)
        parts, whole = {}, set()
        for c in chunks:
            if c not in have:
                core = c.rstrip(SIGNS)
                tail = c[len(core):]
                if tail and b"'" not in tail and ends_in_letter(core):
                    parts[c] = core, tail
                else:
                    whole.add(c)
        asked = [p for p in {p for both in parts.values() for p in both} if p not in have and p not in whole]
        new = list(whole)
        for p, ids, unit in zip(asked, self.cores.find(asked), self.known.find(asked)):
            ids = unit if ids is None else ids
            if ids is None:
                new.append(p)
            else:
                have[p] = ids
        have.update(self.word_ids([p for p in new if p.isalpha()], True))
        rest = [p for p in new if p not in have]
        if self.always_ends:
            have.update(self.word_ids([p for p in rest if not p.isascii() and p.decode().isalpha()], False))
            rest = [p for p in rest if p not in have]
        for at in range(0, len(rest), 5000):
            some = rest[at:at + 5000]
            have.update((p, i.tobytes()) for p, i in zip(some, self.encode([p.decode() for p in some])))
        self.cores.keep_all(asked, [have[p] for p in asked])
        have.update((c, have[core] + have[tail]) for c, (core, tail) in parts.items())
        return have

    def values(self, units: list[bytes]) -> list[bytes]:
        """Packed ids of different units."""
        out = self.known.find(units)
        new = [k for k, ids in enumerate(out) if ids is None]
        if new:
            learned = self.learn([units[k] for k in new])
            for k in new:
                out[k] = learned[units[k]]
        self.known.keep_all(units, out, new)
        return out

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Packed u32 ids of each text."""
        if not self.by_chunk:
            return [i.tobytes() for i in self.encode([t.decode() for t in texts])]
        out: list = [None] * len(texts)
        plain = []
        for k, text in enumerate(texts):
            if SPECIAL in text:
                out[k] = self.encode([text.decode()])[0].tobytes()
            elif len(text) > PIECE_BYTES:  # in parts, cut at blanks
                out[k] = b"".join(self.unit_ids([part])[0] for part in parts_of(text, PIECE_BYTES))
            else:
                plain.append(k)
        for k, ids in zip(plain, self.unit_ids([texts[k] for k in plain])):
            out[k] = ids
        return out

    def unit_ids(self, texts: list[bytes]) -> list[bytes]:
        data = (b"\n".join(texts) + b"\n").translate(LOWER)
        at = np.cumsum([0] + [len(t) + 1 for t in texts])
        starts, ends = unit_spans(data)
        if not len(starts):
            return [b""] * len(texts)
        cut = np.searchsorted(starts, at)
        offsets = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=offsets[1:])
        del starts, ends
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data.translate(None, BLANKS))])
        different = units.dictionary_encode()
        del data, offsets, units
        _, at, body = different.dictionary.buffers()
        at, body = np.frombuffer(at, np.int64, len(different.dictionary) + 1).tolist(), body.to_pybytes()
        values = self.values([body[a:b] for a, b in zip(at, at[1:])])
        code = different.indices.to_numpy()
        del different, at, body
        sizes = np.fromiter(map(len, values), np.int32, len(values)) // 4
        n = sizes[code]
        edge = np.zeros(len(code) + 1, np.int64)
        np.cumsum(n, out=edge[1:])
        first = np.cumsum(sizes, dtype=np.int64) - sizes
        place = np.repeat(first[code] - edge[:-1], n)
        place += np.arange(edge[-1])
        ids = np.frombuffer(b"".join(values), "<u4")[place]
        cut = edge[cut].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cut, cut[1:])]


def unit_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where units begin and end in bytes that end in a blank, as int32 numbers where they fit."""
    kind = np.frombuffer(data.translate(_KIND), np.uint8)
    small = np.int32 if len(data) < 2**31 else np.int64
    inside = kind > 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    parted = inside.copy()
    parted[0] = False
    parted[1:] &= inside[:-1] & (kind[1:] != kind[:-1])
    hard = np.flatnonzero(kind == _HARD)
    if len(hard):  # chunks that stay whole
        chunk = np.flatnonzero(begins).astype(small)
        whole = np.zeros(len(chunk), bool)
        whole[np.searchsorted(chunk, hard, "right") - 1] = True
        parted[chunk[0]:] &= ~np.repeat(whole, np.diff(chunk, append=small(len(data))))
    begins |= parted
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | begins[1:])).astype(small) + small(1)
    return np.flatnonzero(begins).astype(small), ends


def parts_of(text: bytes, size: int) -> Iterator[bytes]:
    """A text in parts of about ``size`` bytes that end before a blank."""
    at = 0
    while at < len(text):
        found = _BLANK.search(text, at + size)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def ends_in_letter(core: bytes) -> bool:
    """Whether the last character is an ASCII letter or digit, or a letter that lower case
    leaves one character."""
    if not core or core[-1] < 128:
        return core[-1:].isalnum()
    last = core[-4:].decode(errors="ignore")[-1:]
    return last.isalpha() and len(last.lower()) == 1


def small_letters_stay(path: str) -> bool:
    """Whether all that the tokenizer file does before its model leaves words of small ASCII letters, blanks
    between, as they are."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    first = spec.get("normalizer") or {}
    steps = first.get("normalizers", [first] if first else [])
    kept = all(s["type"] in ("NFC", "Lowercase") or (s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " ") for s in steps)
    first, *others = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    parted = (first.get("pattern") or {}).get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    plain = all(s["type"] == "ByteLevel" and not s["add_prefix_space"] and not s.get("use_regex", True) for s in others)
    return splits_on_blanks(path) and kept and parted and plain


def splits_on_blanks(path: str) -> bool:
    """Whether the tokenizer file drops white space before its words are made and
    has no token that holds or strips any."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    first = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["content"].split() != [t["content"]])
                for t in spec.get("added_tokens", []))
    pattern = (first.get("pattern") or {}).get("Regex", "")
    return drops and plain and r"[^\s" in pattern


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder, kept between tasks."""
    claim("tokens", _ENCODERS.clear)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# ---- the code -------------------------------------------------------------------


def pack_level(values: np.ndarray, more: np.ndarray) -> bytes:
    """One level: its chunks, which entries continue, and set bits before each block."""
    bits = np.packbits(more, bitorder="little")
    per_block = np.add.reduceat(more, np.arange(0, len(more), RANK_BLOCK), dtype=np.uint32) if len(more) else np.zeros(0, "u4")
    rank = np.zeros(len(per_block) + 1, "<u4")
    np.cumsum(per_block, out=rank[1:])
    return struct.pack("<Q", len(values)) + values.astype("u1").tobytes() + bits.tobytes() + rank.tobytes()


def pack_segment(doc_ids: list[int | None], firsts: np.ndarray, ids: np.ndarray, before: int) -> bytes:
    """A segment's bytes. ``firsts`` has the first id of each document and the end."""
    levels, rest = [], ids
    while True:
        more = rest >> CHUNK_BITS > 0
        levels.append(pack_level(rest & (2**CHUNK_BITS - 1), more))
        rest = rest[more] >> CHUNK_BITS
        if not len(rest):
            break
    head = MAGIC + struct.pack("<III", CHUNK_BITS, len(levels), RANK_BLOCK)
    head += struct.pack("<QQQ", len(doc_ids), len(ids), before)
    head += np.array([d or 0 for d in doc_ids], "<i8").tobytes()
    head += np.array([d is None for d in doc_ids], "u1").tobytes()
    return head + firsts.astype("<u8").tobytes() + b"".join(levels)


class Segment:
    """Read access to a segment's bytes: single tokens, or slices, without decoding
    what lies before them."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a DAC1 segment")
        self.chunk_bits, n_levels, self.block = struct.unpack_from("<III", data, 4)
        self.n_docs, self.n_ids, self.before = struct.unpack_from("<QQQ", data, 16)
        at = 40
        ids = np.frombuffer(data, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        null = np.frombuffer(data, "u1", self.n_docs, at)
        at += self.n_docs
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null)]
        self.firsts = np.frombuffer(data, "<u8", self.n_docs + 1, at).astype(np.int64)
        at += 8 * (self.n_docs + 1)
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            at += 8
            chunks = np.frombuffer(data, "u1", n, at)
            at += n
            bits = np.frombuffer(data, "u1", (n + 7) // 8, at)
            at += len(bits)
            blocks = -(-n // self.block) + 1
            rank = np.frombuffer(data, "<u4", blocks, at)
            at += 4 * blocks
            self.levels.append((chunks, bits, rank))

    def rank(self, level: int, i: int) -> int:
        """Entries of the level before ``i`` that continue."""
        _, bits, rank = self.levels[level]
        whole = i // self.block
        part = np.unpackbits(bits[whole * self.block // 8:(i + 7) // 8], bitorder="little")[: i - whole * self.block]
        return int(rank[whole]) + int(part.sum())

    def token(self, i: int) -> int:
        """Id ``i`` of the segment: one chunk, one bit and one rank by level."""
        value, level = 0, 0
        while True:
            chunks, bits, _ = self.levels[level]
            value |= int(chunks[i]) << (level * self.chunk_bits)
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            i, level = self.rank(level, i), level + 1

    def tokens(self, lo: int, hi: int) -> np.ndarray:
        """Ids ``lo`` to ``hi`` (without ``hi``) as u32: ranks give the slice of each level."""
        out = np.zeros(hi - lo, "<u4")
        at = np.arange(hi - lo)
        for level, (chunks, bits, _) in enumerate(self.levels):
            out[at] |= chunks[lo:hi].astype("<u4") << np.uint32(level * self.chunk_bits)
            if level + 1 == len(self.levels) or lo == hi:
                break
            more = np.unpackbits(bits[lo >> 3:(hi + 7) >> 3], bitorder="little")[lo & 7:][: hi - lo].astype(bool)
            at, (lo, hi) = at[more], (self.rank(level, lo), self.rank(level, lo) + int(more.sum()))
        return out


# ---- Spark ----------------------------------------------------------------------


def encode_segments(docs: DataFrame, path: str | None = None, end_id: int = END_ID,
                    segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """``docs`` (doc_id, text) as segments in ascending doc_id order."""
    ship(docs.sparkSession)
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), struct.pack("<I", end_id)
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        doc_ids, parts, lengths, held = [], [], [], 0

        def close():
            ids = np.frombuffer(b"".join(parts), "<u4")
            firsts = np.concatenate([[0], np.cumsum(lengths)])
            row = [part], [seq], [len(ids)], [pack_segment(doc_ids, firsts, ids, before)]
            return pa.RecordBatch.from_arrays(
                [pa.array(row[0], pa.int32()), pa.array(row[1], pa.int32()), pa.array(row[2], pa.int64()),
                 pa.array(row[3], pa.binary())], ["range", "seq", "n_ids", "segment"])

        for batch in batches:
            for piece, texts in pieces(batch, "text"):
                for doc, ids in zip(piece.column("doc_id").to_pylist(), enc.ids(texts)):
                    doc_ids.append(doc)
                    parts.append(ids + end)
                    lengths.append(len(ids) // 4 + 1)
                    held += lengths[-1]
                    if held >= segment_ids:
                        yield close()
                        seq, before = seq + 1, before + held
                        doc_ids, parts, lengths, held = [], [], [], 0
        if doc_ids:
            yield close()
        give_back()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = [F.col("doc_id"), F.xxhash64("text")]  # rows of one id, or of none, are many ranges'
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, SEGMENT_SCHEMA)


def write_tokens(docs: DataFrame, to: str, **how) -> None:
    """Encode ``docs`` and write the segments to a folder."""
    encode_segments(docs, **how).write.parquet(to)


def read_documents(segments: DataFrame) -> DataFrame:
    """Documents of written segments: doc_id, start, n_tokens, ids_crc32 and the
    ids' place (range, seq, first). Starts add up ids per range (one row each), then
    those before the segment in its range, which the segment itself states."""
    ship(segments.sparkSession)
    totals = segments.groupBy("range").agg(F.sum("n_ids").alias("n_ids"))
    order = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per written range, so a single task may add them up and every task may hold them
    offsets = totals.select(F.col("range").alias("at_range"), F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("base"))

    def run(batches):
        for batch in batches:
            for part, seq, data in zip(batch.column("range").to_pylist(), batch.column("seq").to_pylist(), batch.column("segment")):
                seg = Segment(data.as_py())
                starts, ends = seg.firsts[:-1], seg.firsts[1:]
                crcs = np.empty(seg.n_docs, np.int64)
                for lo in range(0, seg.n_docs, 256):
                    hi = min(lo + 256, seg.n_docs)
                    ids = seg.tokens(int(starts[lo]), int(ends[hi - 1])).tobytes()
                    view, base = memoryview(ids), int(starts[lo])
                    for k in range(lo, hi):
                        crcs[k] = zlib.crc32(view[4 * (int(starts[k]) - base):4 * (int(ends[k]) - base)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * seg.n_docs, pa.int32()), pa.array([seq] * seg.n_docs, pa.int32()),
                     pa.array(seg.doc_ids, pa.int64()), pa.array(starts + seg.before), pa.array(ends - starts),
                     pa.array(crcs), pa.array(starts)],
                    ["range", "seq", "doc_id", "in_range", "n_tokens", "ids_crc32", "first"])

    docs = segments.select("range", "seq", "segment").mapInArrow(
        run, "range int, seq int, doc_id long, in_range long, n_tokens long, ids_crc32 long, first long")
    joined = docs.join(F.broadcast(offsets), docs["range"] == offsets["at_range"])
    return joined.select("doc_id", (F.col("base") + F.col("in_range")).alias("start"), "n_tokens", "ids_crc32",
                         "range", "seq", "first")


def token_output(docs: DataFrame, path: str | None = None, to: str | None = None) -> DataFrame:
    """Write ``docs`` as segments (to a new folder in the shared one unless ``to``
    says where), read them back, one row per document."""
    segments = encode_segments(docs, path)
    if to is None:
        return read_documents(stored(segments, "token-segments"))
    segments.write.parquet(to)
    return read_documents(docs.sparkSession.read.schema(segments.schema).parquet(to))
