import random

import pyarrow as pa
from pyspark.sql import functions as F

from ledgerflow.llm import common as C
from ledgerflow.llm.common import CLEANUP_KEY, IdFilter, blank_words, shingles, stored
from ledgerflow.llm.graph import components


def test_shingles_are_those_of_the_words():
    random.seed(1)
    texts = [" ".join(random.choice("aBcd") * random.randint(1, 3) for _ in range(random.randint(0, 30))) for _ in range(300)]
    texts += ["", " ", "one", "a\x0bb\x0cc d\te", "é É e", "x" * 50]
    sets = shingles([t.encode() for t in texts])
    seen = {}
    for text, own in zip(texts, sets):
        w = blank_words(text.encode())
        want = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        assert len(own) == len(want)
        seen.setdefault(frozenset(want), set()).add(own.tobytes())
    assert all(len(v) == 1 for v in seen.values())
    assert len({next(iter(v)) for v in seen.values()}) == len(seen)


def test_a_word_longer_than_a_piece_is_hashed_whole():
    long = b"z" * 9_000_000
    a, b, c = shingles([b"p " + long + b" q r s t", long, b"a b c d e f"])
    assert len(a) == 2 and len(b) == 1 and (c == shingles([b"a b c d e f"])[0]).all()


def test_id_filter_has_all_ids_and_few_others(spark):
    f = IdFilter.of(spark.range(0, 5000).repartition(3))
    import numpy as np
    assert f.has(np.arange(5000)).all() and f.has(np.arange(10**6, 10**6 + 10**5)).mean() < 0.12
    assert not IdFilter.of(spark.range(0)).has(np.arange(100)).any()


def test_components_are_those_of_union_find(spark):
    random.seed(3)
    links = [(random.randrange(300), random.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 440)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root) if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_stored_step_leaves_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: sum(disk.getAllFiles().apply(k).getName().startswith("shuffle_") for k in range(disk.getAllFiles().size()))
    before, setting = held(), spark.conf.get(CLEANUP_KEY)
    rows = spark.range(0, 5000, 1, 3)
    kept = stored(rows.repartition(3, "id").groupBy((rows.id % 10).alias("g")).count(), "tidy")
    IdFilter.of(rows.repartition(3))
    assert held() <= before and kept.count() == 10 and spark.conf.get(CLEANUP_KEY) == setting


def test_stored_steps_hand_small_batches_to_python(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    before = spark.conf.get(C.BATCH_KEY)
    rows = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
    found = [r["n"] for r in C.stored(rows.mapInArrow(sizes, "n long"), "test-batches").collect()]
    assert sum(found) > 25e6 and max(found) < 2 * C.BATCH_BYTES and spark.conf.get(C.BATCH_KEY) == before
