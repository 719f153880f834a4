"""N-gram Jaccard join by prefix trees.

A document is the set of its distinct ``N``-word shingles (A-Z lower-cased, words between
ASCII white space), as 64-bit hashes; with fewer words the whole sequence is the one
shingle, without words the set is empty and links with nothing. Two documents link
when 100 * intersection >= ``PERCENT`` * union. The result is exact but for hash
collisions inside a pair of sets (2^-64 for each pair of shingles).

1. Peel. A document whose partner exists has at most n - ceil(0.75 n) shingles that no
   other document has. Shingles of half of the hash space are counted, each task
   sending one of those it saw more than once; documents with too many lone ones in
   that half are out.
2. Equal sets among the rest become one, so copies are never compared. The shingles of
   what is left are counted exactly, and documents with too many lone ones are out.
3. Prefix filter. In the global order (rarest first), linked sets share one of their first
   n - ceil(0.75 n) + 1 shingles. Documents that share such a shingle meet in the group of
   the smallest of their ids: a star by shingle, so a document goes to a few groups, not
   to one for each shingle.
4. Prefix trees. In a group the sets, ordered the most frequent first, are stored in a trie,
   held as its sorted sequences with their common prefixes. Each set walks the trie level
   by level; nodes carry the overlap so far, shared by all sets below them, and a node
   is left when the overlap and what remains of both sides cannot reach the smallest
   need below it, or no size below it can match. Groups over ``GROUP_DOCS``
   are cut into blocks, and every two blocks meet, each pair in a task of its own.
5. Links of a group are reduced to a spanning forest, and components are found by
   large-star and small-star steps.

A null doc_id has its n_shingles, component null and no links (in ``keep_one_of_each`` it
links by its text). Rows that share a doc_id are
one node of the graph, each row with its own n_shingles. An empty table gives no rows. Other
columns are ignored, or kept by ``keep_one_of_each``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import IdFilter, lean, pieces, shingles, stored
from ledgerflow.llm.graph import components

N = 5
PERCENT = 75
#: Shingles that one task of the peel counts, about.
PART_SHINGLES = 1_000_000
#: Text that is shingled at once, in bytes.
CHUNK_BYTES = 3 << 20
#: Sets that one task compares, in a group or from each of two blocks.
GROUP_DOCS = 1000
#: Links that a task sends on at once, about.
SENT_LINKS = 1 << 14


def needed(n: np.ndarray) -> np.ndarray:
    """Shared shingles without which a set of ``n`` has no partner."""
    return -(-PERCENT * n // 100)


# ---- peel -------------------------------------------------------------------------


def half_counts(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n, lone, shared): for each row of ``docs`` one with n shingles, of which
    ``lone`` of the counted half were alone in their chunk of rows; and rows with n null
    that say how many of those another chunk has."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, int(size // 12 // PART_SHINGLES) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in pieces(batch, "text", CHUNK_BYTES):
                sets = shingles(texts, N)
                half = [s[:np.searchsorted(s, np.uint64(1 << 63))] for s in sets]
                n = np.array([len(s) for s in half])
                keys, owner = np.concatenate(half), np.repeat(np.arange(len(half)), n)
                order = np.argsort(keys, kind="stable")
                keys, owner = keys[order], owner[order]
                first = np.ones(len(keys), bool)
                first[1:] = keys[1:] != keys[:-1]
                alone = first & np.append(first[1:], True)[:len(first)]
                lone = np.bincount(owner[alone], minlength=len(half))
                yield rows_of([-1] * 1, [blob(piece, [len(s) for s in sets], lone)])
                # one row for each part: keys, their documents (null id: none to credit), whether seen twice here
                ids = piece.column("doc_id")
                null = ids.is_null().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy()
                keys, owner, twice = keys[first], owner[first], ~alone[first]
                part = ((keys >> np.uint64(31)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                cut = np.searchsorted(part, np.arange(parts + 1))
                full = np.flatnonzero(cut[1:] > cut[:-1])
                packed = []
                for a, b in zip(cut[full].tolist(), cut[full + 1].tolist()):
                    own = owner[a:b]
                    credit = ~(twice[a:b] | null[own])
                    packed.append(pack(keys[a:b], ids[own], credit))
                yield rows_of(full.astype(np.int32), packed)  # at once: there are as many parts as the corpus is large

    groups = max(1, parts // 8)  # documents are dealt to so many tasks to add up their parts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("body")):
                if part < 0:
                    yield rows_of([-1], [data.as_py()])
                    continue
                if part != at and held:
                    yield by_group(*shared(held), groups)
                    held = []
                at = part
                held.append(unpack(data.as_py()))
        if held:
            yield by_group(*shared(held), groups)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("body")):
                if part < 0:
                    yield unblob(data.as_py())
                    continue
                more = np.frombuffer(data.as_py(), "<i8").reshape(2, -1)
                ids, place = np.unique(np.concatenate([who, more[0]]), return_inverse=True)
                who, n = ids, np.bincount(place, weights=np.concatenate([n, more[1]]), minlength=len(ids)).astype(np.int64)
        none = pa.nulls(len(who), pa.int64())
        yield _frame(pa.array(who), none, none, pa.array(n))

    rows = docs.mapInArrow(lean(run), "part int, body binary").withColumn(
        "task", F.when(F.col("part") < 0, F.pmod(F.xxhash64("body"), F.lit(parts)).cast("int")).otherwise(F.col("part")))
    dealt = rows.repartition(parts, "task").sortWithinPartitions("part").select("part", "body")
    counts = dealt.mapInArrow(lean(count), "part int, body binary").withColumn(
        "task", F.when(F.col("part") < 0, F.pmod(F.xxhash64("body"), F.lit(groups)).cast("int")).otherwise(F.col("part")))
    return counts.repartition(groups, "task").select("part", "body").mapInArrow(lean(add_up), "doc_id long, n long, lone long, shared long")


def rows_of(parts, bodies) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(bodies, pa.binary())], ["part", "body"])


def _frame(doc_id, n, lone, shared_) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([doc_id, n, lone, shared_], ["doc_id", "n", "lone", "shared"])


def blob(piece, n, lone) -> bytes:
    """A chunk's rows as one value, so that they travel with the packed keys."""
    nothing = pa.array([0] * len(n), pa.int64())
    batch = _frame(piece.column("doc_id"), pa.array(n, pa.int64()), pa.array(lone, pa.int64()), nothing)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unblob(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def pack(keys: np.ndarray, ids: np.ndarray, credit: np.ndarray) -> bytes:
    """Low 48 bits of the keys, and whom to credit: a place in the list of the ids + 1, or 0."""
    owners, place = np.unique(ids[credit], return_inverse=True)
    to = np.zeros(len(keys), "<u4")
    to[credit] = place + 1
    head = np.array([len(keys), len(owners), 2 if len(owners) < 65535 else 4], "<i8").tobytes()
    low = keys.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    return head + owners.astype("<i8").tobytes() + low + to.astype(f"<u{2 if len(owners) < 65535 else 4}").tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, n_owners, width = np.frombuffer(data, "<i8", 3)
    owners = np.frombuffer(data, "<i8", n_owners, 24)
    at = 24 + 8 * n_owners
    keys = np.zeros((n, 8), np.uint8)
    keys[:, :6] = np.frombuffer(data, np.uint8, 6 * n, at).reshape(n, 6)
    to = np.frombuffer(data, f"<u{width}", n, at + 6 * n)
    return keys.view(np.uint64).ravel(), np.append(owners, 0)[to.astype(np.int64) - 1], to > 0


def by_group(who: np.ndarray, n: np.ndarray, groups: int) -> pa.RecordBatch:
    """Documents and their counts as a value for each group of documents."""
    group = np.mod(who, groups)
    found = np.unique(group).tolist()
    return rows_of(found, [np.stack([who[group == g], n[group == g]]).astype("<i8").tobytes() for g in found])


def shared(held) -> tuple[np.ndarray, np.ndarray]:
    """Of one part: how many of a document's lone shingles another chunk has."""
    keys, ids, credit = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(keys, kind="stable")
    keys, ids, credit = keys[order], ids[order], credit[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    both = ~(first & np.append(first[1:], True))
    return np.unique(ids[both & credit], return_counts=True)


# ---- prefix filter ----------------------------------------------------------------


def sets_of(docs: DataFrame, wanted: IdFilter) -> DataFrame:
    """(doc_id, n, digest, body): the sets of the wanted documents, 8 bytes a shingle."""
    held = docs.sparkSession.sparkContext.broadcast(wanted)  # IdFilter.MOST_BITS at most

    def run(batches):
        for batch in batches:
            batch = batch.filter(keep(batch.column("doc_id"), held.value))
            for piece, texts in pieces(batch, "text", CHUNK_BYTES):
                sets = [s.tobytes() for s in shingles(texts, N)]
                rows = pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array([len(s) // 8 for s in sets], pa.int64()),
                     pa.array([hashlib.blake2b(s, digest_size=16).digest() for s in sets], pa.binary()), pa.array(sets, pa.binary())],
                    ["doc_id", "n", "digest", "body"])
                yield rows.filter(pa.array([len(s) > 0 for s in sets], pa.bool_()))

    return docs.mapInArrow(lean(run), "doc_id long, n long, digest binary, body binary")


def keep(ids: pa.Array, wanted: IdFilter) -> pa.Array:
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    return pa.array(known & wanted.has(ids.fill_null(0).to_numpy()), pa.bool_())


def only(sets: DataFrame, wanted: IdFilter) -> DataFrame:
    """Rows of stored sets that the filter lets through."""
    held = sets.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        for batch in batches:
            yield batch.filter(keep(batch.column("doc_id"), held.value))

    return sets.mapInArrow(lean(run), sets.schema)


def keys_of(sets: DataFrame, wanted: IdFilter) -> DataFrame:
    """(key, doc_id, n): a row for each shingle of the wanted sets."""
    held = sets.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                some = some.filter(keep(some.column("doc_id"), held.value))
                n = some.column("n").to_numpy()
                keys = np.frombuffer(b"".join(some.column("body").to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(np.repeat(some.column("doc_id").to_numpy(), n)), pa.array(np.repeat(n, n))], ["key", "doc_id", "n"])

    return sets.select("doc_id", "n", "body").mapInArrow(lean(run), "key long, doc_id long, n long")


def memberships(sets: DataFrame, wanted: IdFilter) -> DataFrame:
    """(leader, doc_id): the groups in which wanted documents that share a prefix
    shingle meet."""
    keys = keys_of(sets, wanted)
    counts = keys.groupBy("key").agg(F.count("*").alias("docs")).where("docs > 1")
    known = keys.join(counts, "key").groupBy("doc_id", "n").agg(F.collect_list(F.struct("docs", "key")).alias("known"))
    need = F.expr(f"({PERCENT} * n + 99) div 100")
    known = known.where(F.size("known") >= need)
    # the n - size lone shingles come first in the order
    prefix = F.expr("slice(array_sort(known), 1, greatest(0, cast(size(known) as int) - cast(need as int) + 1))")
    posts = known.withColumn("need", need).select("doc_id", F.explode(prefix["key"]).alias("key"))
    posts = stored(posts, "ngram-prefixes")
    stars = posts.groupBy("key").agg(F.min("doc_id").alias("leader"), F.count("*").alias("m")).where("m > 1").drop("m")
    return posts.join(stars, "key").select("leader", "doc_id").distinct()


def meetings(members: DataFrame) -> DataFrame:
    """(leader, i, j, block, doc_id): groups in blocks, each two of which meet."""
    sizes = members.groupBy("leader").agg(F.count("*").alias("m")).where("m > 1")
    blocks = F.ceil(F.col("m") / GROUP_DOCS).cast("int")
    rows = members.join(sizes, "leader").select("leader", "doc_id", blocks.alias("blocks"), F.pmod(F.xxhash64("doc_id"), blocks).cast("int").alias("block"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)  # its own block is one of them
    rows = rows.select("leader", "doc_id", "block", F.explode(others).alias("other"))
    return rows.select("leader", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id")


# ---- prefix trees -----------------------------------------------------------------


class Trie:
    """Sets over 0..v-1 (ascending arrays) as a trie with paths of single children
    merged: sorted sequences, and for each node its stretch of one of them."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u4").tobytes())
        rows = [sets[k] for k in self.order]
        sizes = sizes[self.order]
        common = [0] + [self._common(a, b) for a, b in zip(rows, rows[1:])]
        # nodes in preorder: parent, stretch of a row, first row below, rows that end in it
        parent, row, begin, end, low, high = [-1], [0], [0], [0], [0], [len(rows)]
        self.ends: list[list[int]] = [[]]
        stack = [0]
        for r, (own, same) in enumerate(zip(rows, common)):
            last = None
            while end[stack[-1]] > same:
                last = stack.pop()
                high[last] = r
            top = stack[-1]
            if last is not None and end[top] < same:  # the path is parted inside ``last``
                parent.append(top)
                row.append(row[last])
                begin.append(begin[last])
                end.append(same)
                low.append(low[last])
                high.append(len(rows))
                self.ends.append([])
                parent[last], begin[last] = len(parent) - 1, same
                top = len(parent) - 1
                stack.append(top)
            if len(own) > same:
                parent.append(top)
                row.append(r)
                begin.append(same)
                end.append(len(own))
                low.append(r)
                high.append(len(rows))
                self.ends.append([])
                top = len(parent) - 1
                stack.append(top)
            self.ends[top].append(r)
        self.parent, self.begin, self.end = map(np.array, (parent, begin, end))
        self.low, self.high = np.array(low), np.array(high)
        offset = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
        self.tokens = np.concatenate([*rows, np.zeros(1, np.int64)]).astype(np.int64)
        self.at = offset[np.array(row)] + self.begin
        self.after = np.where(self.end > self.begin, self.tokens[np.maximum(self.at + self.end - self.begin - 1, 0)] + 1, 0)
        lengths = np.array([len(x) for x in rows])
        self.most = np.array([lengths[a:b].max() for a, b in zip(self.low, self.high)]) - self.end
        self.least_size = np.array([sizes[a:b].min() for a, b in zip(self.low, self.high)])
        self.most_size = np.array([sizes[a:b].max() for a, b in zip(self.low, self.high)])
        depth = np.zeros(len(parent), int)
        pending = np.arange(1, len(parent))
        up = self.parent.copy()
        while len(pending):  # levels by following parents
            depth[pending] += 1
            up[pending] = self.parent[up[pending]]
            pending = pending[up[pending] >= 0]
        self.levels = [np.flatnonzero(depth == d) for d in range(1, depth.max() + 1)]
        self.sizes = sizes

    @staticmethod
    def _common(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        apart = np.flatnonzero(a[:n] != b[:n])
        return int(apart[0]) if len(apart) else n

    def partners(self, own: np.ndarray, size: int, v: int, after_row: int) -> list[int]:
        """Rows after ``after_row`` whose sets link with ``own``."""
        mark = np.zeros(v + 1, np.int64)
        mark[own] = 1
        rest = np.concatenate([np.cumsum(mark[::-1])[::-1], [0]])
        overlap, alive = np.zeros(len(self.parent), np.int64), np.zeros(len(self.parent), bool)
        alive[0] = True
        found = [0]
        for level in self.levels:
            ids = level[alive[self.parent[level]] & (self.high[level] > after_row + 1)]
            if not len(ids):
                break
            n = self.end[ids] - self.begin[ids]
            edge = np.concatenate([[0], np.cumsum(n)])
            flat = np.arange(edge[-1]) - np.repeat(edge[:-1] - self.at[ids], n)
            overlap[ids] = overlap[self.parent[ids]] + np.add.reduceat(mark[self.tokens[flat]], edge[:-1])
            bound = overlap[ids] + np.minimum(self.most[ids], rest[self.after[ids]])
            fits = (100 + PERCENT) * bound >= PERCENT * (size + self.least_size[ids])
            fits &= (100 * self.most_size[ids] >= PERCENT * size) & (100 * size >= PERCENT * self.least_size[ids])
            ids = ids[fits]
            alive[ids] = True
            found += ids.tolist()
        return [r for k in found for r in self.ends[k] if r > after_row
                and (100 + PERCENT) * overlap[k] >= PERCENT * (size + self.sizes[r])]


def group_links(ids: list[int], blocks: list[int], bodies: list[bytes], apart: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links of a group; with ``apart``, of those between
    its two blocks."""
    sets = [np.frombuffer(b, np.uint64) for b in bodies]
    sizes = np.array([len(s) for s in sets])
    keys, place, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(keys), np.int64)
    rank[np.argsort(-n, kind="stable")] = np.arange(len(keys))
    v = int((n > 1).sum())  # shingles of one set only come last and match nothing
    edge = np.concatenate([[0], np.cumsum(sizes)])
    ranked = rank[place]
    small = []
    for a, b in zip(edge[:-1], edge[1:]):
        own = ranked[a:b]
        small.append(np.sort(own[own < v]))
    trie = Trie(small, sizes)
    parent = list(range(len(ids)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for r, k in enumerate(trie.order):
        for other in trie.partners(small[k], int(sizes[k]), v, r):
            o = trie.order[other]
            if apart and blocks[k] == blocks[o]:
                continue
            a, b = root(k), root(o)
            if a != b:
                parent[a] = b
                out.append((ids[k], ids[o]))
    return out


def links(members: DataFrame, sets: DataFrame, of_group=group_links, chosen: bool = False) -> DataFrame:
    """(a, b): links that connect all that is connected, from stored memberships
    (leader, doc_id) and sets (doc_id, body). ``of_group`` finds those of a group. ``chosen``: the sets
    are those of members only, about."""
    own = sets.select("doc_id", "body")
    own = own if chosen else only(own, IdFilter.of(members.select("doc_id").distinct()))
    rows = meetings(members).join(own, "doc_id")
    dealt = rows.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j")

    def run(batches):
        at, held, found = None, [], []
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                for leader, i, j, *row in zip(*(some.column(c).to_pylist() for c in ("leader", "i", "j", "doc_id", "block", "body"))):
                    if at != (leader, i, j):
                        if len(held) > 1:
                            found += _links(held, at, of_group)
                        at, held = (leader, i, j), []
                        if len(found) >= SENT_LINKS:  # most groups have few
                            yield _sent(found)
                            found = []
                    held.append(row)
        if len(held) > 1:
            found += _links(held, at, of_group)
        yield _sent(found)

    return dealt.select("leader", "i", "j", "doc_id", "block", "body").mapInArrow(lean(run), "a long, b long")


def _links(held, at, of_group) -> list[tuple[int, int]]:
    return stars(of_group(*map(list, zip(*held)), apart=at[1] != at[2]))


def stars(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Links that connect the same as ``found``: of each id to the smallest of its component, so that fewer steps
    find the components of all groups."""
    if len(found) < 2:
        return found
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for a, b in found:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [(r, x) for x in list(parent) if (r := root(x)) != x]


def _sent(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])


# ---- the operator -----------------------------------------------------------------


def cluster(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id that links
    reach, its own included)."""
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counted = stored(half_counts(own), "ngram-counts")
    rows = counted.where("n is not null")
    more = counted.where("n is null").groupBy("doc_id").agg(F.sum("shared").alias("more"))
    lone = F.col("lone") - F.coalesce("more", F.lit(0))
    left = rows.where(f"n > 0 and doc_id is not null and lone > n - ({PERCENT} * n + 99) div 100").join(more, "doc_id", "left")
    out_of = left.where(lone > F.expr(f"n - ({PERCENT} * n + 99) div 100")).select("doc_id", "n")
    stay = rows.where("n > 0 and doc_id is not null").join(out_of, ["doc_id", "n"], "left_anti").select("doc_id").distinct()
    sets = stored(sets_of(own, IdFilter.of(stay)), "ngram-sets")
    first = stored(sets.groupBy("digest").agg(F.min("doc_id").alias("rep")), "ngram-firsts")
    same = sets.select("doc_id", "digest").join(first, "digest").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    members = stored(memberships(sets, IdFilter.of(first.select("rep"))), "ngram-members")
    found = components(same.unionAll(links(members, sets)), "ngram-links")
    out = rows.select("doc_id", F.col("n").alias("n_shingles")).join(found.select(F.col("id").alias("doc_id"), "root"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def without_repeats(rows: DataFrame) -> DataFrame:
    """``rows`` (row, a struct of all columns) with one row of each (doc_id, text), null equal to null.
    Only rows that are there again are grouped, and a group is combined before the shuffle."""
    keyed = rows.select("row", F.col("row.doc_id").alias("id"), F.md5(F.col("row.text").cast("string").cast("binary")).alias("digest"))
    again = stored(keyed.groupBy(F.col("id").alias("same_id"), F.col("digest").alias("same")).agg(F.count("*").alias("n"))
                   .where("n > 1").drop("n"), "ngram-repeats")
    if again.isEmpty():
        return rows
    both = F.col("id").eqNullSafe(F.col("same_id")) & F.col("digest").eqNullSafe(F.col("same"))
    # the first as JSON, so that it doesn't depend on the order of rows
    first = keyed.join(again, both, "left_semi").groupBy("id", "digest").agg(F.min_by("row", F.to_json("row")).alias("row"))
    one = keyed.join(again, both, "left_anti").select("row").unionByName(first.select("row"))
    return stored(one, "ngram-rows")


def node():
    """A row's node in the graph: its doc_id, or for a null one a number of its text, from 2^62 on."""
    text = F.col("row.text").cast("string")
    own = F.xxhash64(text).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    return F.coalesce(F.col("row.doc_id").cast("long"), F.when(text.isNotNull(), own))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest doc_id, and one row
    of each (doc_id, text). Rows with a null doc_id link by their texts, and stay only where
    no doc_id below 2^62 is in the component. Rows are packed meanwhile, so columns of any name pass."""
    rows = without_repeats(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")))
    found = cluster(rows.select(node().alias("doc_id"), F.col("row.text").alias("text")))
    later = found.where("component_id <> doc_id").select(F.col("doc_id").alias("later")).distinct()
    return rows.join(later, node() == F.col("later"), "left_anti").select("row.*")
