import random
import zlib

import numpy as np

from llm_cases import nothing, odd, sf  # noqa: F401  fixtures
from pyspark.sql import functions as F
from ledgerflow.llm import language_id, source_mix, toxicity
from ledgerflow.llm import multiset_fingerprint as fp
from ledgerflow.llm import queries as Q


def test_language_id_on_held_out_documents(spark, sf):
    got = {r["doc_id"]: r for r in Q.op9_language_id(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    held = [r for r in docs if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert held and all(got[r["doc_id"]]["held_out"] for r in held)
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_id_of_odd_rows(spark, odd, nothing):
    model = language_id.train(odd)
    got = language_id.predict(odd, model).collect()
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    assert len(got) == odd.count()
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in texts[r["doc_id"]] or "")) for r in got if r["doc_id"] not in (1, None))
    assert {r["lang_pred"] for r in language_id.predict(odd, None).collect()} == {"und"}
    assert language_id.train(nothing) is None and language_id.predict(nothing, model).count() == 0
    kept = language_id.keep_known(odd, model, 0.0)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {1, None, 5, 6, 8}


def toxic_corpus(spark):
    random.seed(4)
    words = ["the", "house", "stands", "near", "water", "green", "little", "road", "people", "walk", "often", "summer", "lost", "window"]
    docs, labels = [], []
    for k in range(600):
        w = [random.choice(words) for _ in range(40)]
        toxic = k % 4 == 0
        if toxic:
            w[random.randrange(40)] = random.choice(["idiot", "moron", "loser"])
        docs.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_disguised_words_are_restored_and_scored(spark, odd, nothing):
    docs, labels = toxic_corpus(spark)
    model = toxicity.train(docs, labels, toxicity.fifth() != 0)
    assert {"idiot", "moron", "loser"} <= set(model.words)
    for hidden, word in [("1d10t", "idiot"), ("m0r0n", "moron"), ("l.o.s.e.r", "loser"), ("looooser", "loser"), ("i-d-i-o-t", "idiot"), ("mor0n", "moron")]:
        assert toxicity.decode(hidden, model.letters) == word, hidden
    texts = ["the house", "you 1d10t here", "an i d i o t walks", "LOOOOSER!!", "m.o.r.o.n", "a b c", "", None, "the road is 100 m long (about)"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(rows, model).collect()}
    assert [got[k] >= 0.5 for k in range(9)] == [False, True, True, True, True, False, False, False, False]
    assert len(toxicity.score(odd, model).collect()) == odd.count() and toxicity.score(nothing, model).count() == 0
    empty = toxicity.train(docs, labels.limit(0))
    assert toxicity.score(rows, empty).where("score >= 0.5").count() == 0
    assert toxicity.train(nothing, labels).words == {}


def edge_corpus(spark):
    """Like ``toxic_corpus``, with one-letter words."""
    random.seed(5)
    words = ["a", "i", "you", "are", "an", "the", "house", "near", "water", "green", "people", "walk", "often", "window"]
    docs, labels = [], []
    for k in range(600):
        w = [random.choice(words) for _ in range(40)]
        if k % 4 == 0:
            w[random.randrange(40)] = random.choice(["idiot", "moron", "loser", "shit", "ass"])
        docs.append((k, " ".join(w)))
        labels.append((k, int(k % 4 == 0)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_signs_and_blanks_are_read_as_word_edges(spark):
    model = toxicity.train(*edge_corpus(spark))
    assert {"idiot", "moron", "loser", "shit", "ass"} == set(model.words)
    scorer = toxicity.Scorer(model.letters, model.words)
    hidden = {
        "you are a m o r o n": "moron", "I i d i o t": "idiot", "a l o o o o s e r": "loser", "i d i o t m o r o n": "idiot moron", "are a 1 d i 0 t, walk": "idiot",
        "idiot,moron": "idiot moron", "you/idiot": "idiot", "idiot...you": "idiot", "you/1d10t": "idiot", "m.o.r.o.n/l.o.s.e.r": "moron loser",
        "$#!7": "shit", "455": "ass", "the 455!": "ass", "($#!7!)": "shit"}
    for text, words in hidden.items():
        assert set(words.split()) <= scorer.words(text.encode()), text
    clean = ["a b c", "you/are", "house,window", "in 2024 or 100", "$$$ ||| !!!", "| | |", "a i a i", "-", "a, i, you"]
    rows = spark.createDataFrame(list(enumerate([*hidden, *clean])), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] >= 0.5 for r in toxicity.score(rows, model).collect()}
    assert [got[k] for k in range(len(got))] == [True] * len(hidden) + [False] * len(clean)


def test_all_weighted_readings_of_a_token_count():
    model = np.zeros(toxicity.SIGNS**toxicity.ORDER, np.float32)
    scorer = toxicity.Scorer(model, {"idiot": 1, "moron": 2, "loser": 3})
    assert scorer.found(b"loser/idiot").tolist() == [1, 3]
    # what follows such a token stays in its place
    assert scorer.found(b"moron,idiot,loser z l o s e r moron,loser").tolist() == [1, 2, 3]
    singles = np.array([False, True, True, True, False])
    seen = []
    scorer.spaced = lambda tokens, single: seen.append((tokens, single.tolist())) or []
    assert scorer.found(b"moron,idiot a b c loser/idiot").tolist() == [1, 2, 3]
    assert seen == [([b"moron,idiot", b"a", b"b", b"c", b"loser/idiot"], singles.tolist())]


def test_toxicity_on_held_out_documents(spark):
    docs, labels = toxic_corpus(spark)
    model = toxicity.train(docs, labels, toxicity.fifth() != 0)
    held = toxicity.score(docs.where(toxicity.fifth() == 0), model).join(labels, "doc_id").collect()
    assert held and np.mean([(r["score"] >= 0.5) == (r["toxic"] == 1) for r in held]) > 0.95


def test_gram_counts_follow_the_corpus(spark):
    one = spark.createDataFrame([("ab ab",)], "text string")
    n = lambda df: sum(r["n"] for r in toxicity.gram_counts(df).collect())
    assert n(one.union(one)) > n(one) > 0


def test_fingerprints_are_homomorphic(spark):
    parts = [("a. b.\nc",), ("c\nb. a.",), ("a.",), ("b.\nc",), ("",), ("a. a. b.\nc",)]
    df = spark.createDataFrame(parts, "t string")
    v = df.select("t", fp.vector(fp.F.col("t")).alias("v"))
    rows = {r["t"]: r["v"] for r in v.collect()}
    assert rows["a. b.\nc"] == rows["c\nb. a."] != rows["a. a. b.\nc"]
    both = v.alias("x").join(v.alias("y"), (fp.F.col("x.t") == "a.") & (fp.F.col("y.t") == "b.\nc"))
    assert both.select(fp.combine(fp.F.col("x.v"), fp.F.col("y.v"))).first()[0] == rows["a. b.\nc"]
    less = v.alias("x").join(v.alias("y"), (fp.F.col("x.t") == "a. b.\nc") & (fp.F.col("y.t") == "a."))
    assert less.select(fp.combine(fp.F.col("x.v"), fp.F.col("y.v"), -1)).first()[0] == rows["b.\nc"]
    assert not any(rows[""])


def test_fingerprints_of_edited_texts(spark, odd, nothing, monkeypatch):
    import hashlib
    random.seed(9)
    sentence = lambda: " ".join(f"w{random.randrange(2000)}" for _ in range(6)) + "."
    texts = [" ".join(sentence() for _ in range(random.randint(0, 40))) for _ in range(80)] + ["😀é" * 7, "", "x"]
    docs = spark.createDataFrame([(3 * k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    monkeypatch.setattr(fp, "RANGE_ROWS", 9)
    got = [tuple(r) for r in fp.edited_fingerprints(docs).orderBy("doc_id").collect()]
    for k, (doc, n, sha, own, edited, near, far) in enumerate(got):
        text, after = texts[k], texts[(k + 1) % len(texts)]
        half = len(text) // 2
        assert (doc, n, sha) == (3 * k, len(text), hashlib.sha256((text[:len(text) - half] + after[:half]).encode()).hexdigest())
        assert 0 <= near <= 1 and 0 <= far <= 1
    long = [r for r in got if r[1] > 600]
    # the edited text shares half of its paragraphs or a little less: a third of the union
    assert 0.2 < np.mean([r[5] for r in long]) < 0.5 and np.mean([r[6] for r in long]) < 0.12
    out = fp.edited_fingerprints(odd).collect()
    assert len(out) == odd.count()
    assert len({r["fingerprint"] for r in out if r["doc_id"] in (2, 3, 4)}) == 1
    assert fp.edited_fingerprints(nothing).count() == 0
    one = fp.edited_fingerprints(docs.limit(1)).first()
    assert one["near_next"] == 1.0


def test_next_of_null_ids_in_many_ranges(spark, monkeypatch):
    rows = [(k, f"text {k}. end") for k in range(40)] + [(None, f"null {k}. other words") for k in range(5)] + [(7, "again. seven")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    one = sorted(map(tuple, fp.edited_fingerprints(docs).collect()), key=str)
    monkeypatch.setattr(fp, "RANGE_ROWS", 4)
    assert sorted(map(tuple, fp.edited_fingerprints(docs).collect()), key=str) == one
    after = {r["text"]: r["next_text"] for r in fp.with_next(docs, {}).collect()}
    assert sum(after[t] == "text 0. end" for d, t in rows if d is None) == 1  # the last null row's next is the smallest id's
    assert after["text 39. end"].startswith("null")


def test_mix_reaches_its_targets(spark, sf):
    got = source_mix.taken_words(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    taken = {}
    for r in got:
        assert r["taken"] <= 3 * r["size"]
        s = taken.setdefault(source[r["doc_id"]], [0, r["target"], r["source_size"]])
        s[0] += r["taken"]
    assert all(abs(t - target) <= max(4 * source_mix.BLOCK, 0.05 * target) for t, target, _ in taken.values())
    assert abs(sum(t for _, t, _ in taken.values()) - sum(n for *_, n in taken.values())) < 1
    again = source_mix.taken_words(spark.read.parquet(f"{sf}/documents.parquet").repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_mix_shares_the_excess_of_stopped_sources(spark):
    docs = spark.createDataFrame([(k, "w " * n, s) for k, (n, s) in enumerate([(10, "a"), (1000, "b"), (500, "c"), (300, None), (0, "z")])],
                                 "doc_id long, text string, source string")
    t = {r["__source"]: (r["weight"], r["target"]) for r in source_mix.targets(source_mix.laid_out(docs)).collect()}
    # a stops at 30, z at 0; b (2), c (1) and the null source (2) share 1780; null stops at 900
    assert {k: v[0] for k, v in t.items()} == {"a": 5, "b": 2, "c": 1, "z": 5, None: 2}
    assert t["a"][1] == 30 and t["z"][1] == 0
    assert abs(t["b"][1] - 712) < 1e-6 and abs(t["c"][1] - 356) < 1e-6 and abs(t[None][1] - 712) < 1e-6


def first_plan(df) -> str:
    """The plan before anything has run, as adaptive execution may keep it."""
    return df._jdf.queryExecution().executedPlan().toString()


def mix_plan(spark, n_words=400_000):
    rows = [(k, "w " * n_words, s) for k, s in enumerate(("a", "b", None))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sized = source_mix.stored(source_mix.laid_out(docs).select("doc_id", "__source", "__size", "__place", F.col("doc_id").alias("__uid")), "test-sizes")
    return sized, source_mix.stored(source_mix.stretches(source_mix.targets(sized)), "test-plan")


def test_the_slots_of_a_mix_are_not_gathered_in_the_driver(spark, monkeypatch):
    _, plan = mix_plan(spark)
    mix = source_mix.schedule(plan)
    assert "BuildLeft" not in first_plan(mix) and "BuildRight" in first_plan(mix)
    monkeypatch.setattr(source_mix, "SENT_SOURCES", 2)
    dealt = source_mix.schedule(plan)
    assert first_plan(dealt).count("Broadcast") < first_plan(mix).count("Broadcast")
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, mix.collect()))


def test_the_blocks_of_a_mix_are_not_gathered_in_the_driver(spark):
    sized, plan = mix_plan(spark)
    blocks = source_mix.doc_blocks(source_mix.placed(sized, plan))
    few = spark.range(9).select(F.col("id").cast("int").alias("source_no"), (F.col("id") % 7).alias("block"))
    joined = blocks.join(few, ["source_no", "block"])
    assert "SortMergeJoin [source_no" in first_plan(joined) and "BroadcastHashJoin [source_no" not in first_plan(joined)
    assert joined.count() == 3


def test_mix_documents_gives_the_words_taken(spark, odd, nothing):
    got, want = {}, {}
    for r in source_mix.mix_documents(odd).collect():
        got[r["source"]] = got.get(r["source"], 0) + len((r["text"] or "").split())
        assert r["n_chars"] == len(r["text"])
    names = {r["doc_id"]: r["source"] for r in odd.collect() if r["doc_id"] is not None}
    for r in source_mix.taken_words(odd).where("doc_id is not null").collect():
        want[names[r["doc_id"]]] = want.get(names[r["doc_id"]], 0) + r["taken"]
    assert all(got.get(s, 0) >= n for s, n in want.items())
    assert source_mix.mix_documents(odd).columns == odd.columns
    assert source_mix.mix_documents(nothing).count() == 0 and source_mix.taken_words(nothing).count() == 0
    assert source_mix.taken_words(odd).count() == odd.count()
