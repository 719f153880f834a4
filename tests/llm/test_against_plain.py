"""Fingerprints, language scores and toxicity against plain Python, and the registered queries on
held-out rows."""
import math
import random
import re
import struct
import zlib
from itertools import product

import numpy as np
import xxhash

from llm_cases import nothing, odd, sf  # noqa: F401  fixtures
from ledgerflow.llm import language_id as L
from ledgerflow.llm import multiset_fingerprint as M
from ledgerflow.llm import queries as Q
from ledgerflow.llm import toxicity as T


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chained(*parts):
    """Spark's xxhash64 of several columns: each is hashed with the hash before as seed."""
    h = 42
    for p in parts:
        data = p.encode() if isinstance(p, str) else struct.pack("<i", p) if p.bit_length() < 16 and p >= 0 else struct.pack("<q", p)
        h = xxhash.xxh64_intdigest(data, h)
    return signed(h)


def plain_lanes(text):
    paragraphs = [p for p in re.split(r"\s*\n\s*|(?<=[.!?])\s+", text.strip(" ")) if p]
    lanes = [len(paragraphs)] + [0] * (M.DENSE + M.SIGNS)
    for p in paragraphs:
        a, b = chained(p, 1), chained(p, 2)
        for k in range(M.DENSE):
            h = 42
            for data in (struct.pack("<q", a), struct.pack("<q", b), struct.pack("<i", k)):
                h = xxhash.xxh64_intdigest(data, h)
            lanes[1 + k] = (lanes[1 + k] + (h & (1 << 48) - 1)) % (1 << 48)
        bits = [(w >> s) & 1 for w in (a % (1 << 64), b % (1 << 64)) for s in range(64)]
        # low halves of both words, then high halves
        order = [w * 64 + half * 32 + s for half in (0, 1) for w in (0, 1) for s in range(32)]
        for k, at in enumerate(order):
            lanes[1 + M.DENSE + k] = (lanes[1 + M.DENSE + k] + bits[at]) % (1 << 16)
    return lanes


def test_fingerprint_lanes_are_those_of_plain_sums(spark):
    random.seed(1)
    texts = ["", " ", "one", "a. b! c?", "a. a. a.", "x\n\n y \nz. é 日本", *(" ".join(random.choices(["aa", "b.", "cc!", "d\n", "é"], k=random.randint(1, 60))) for _ in range(40))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["lanes"] for r in M.fingerprints(docs).collect()}
    assert all(got[k] == plain_lanes(t) for k, t in enumerate(texts))


def test_likeness_is_the_estimate_of_the_lanes(spark):
    random.seed(2)
    texts = ["".join(f"p{random.randint(0, 30)}. " for _ in range(random.randint(0, 60))) for _ in range(40)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in M.edited_fingerprints(docs).collect()}
    for k, text in enumerate(texts):
        other = texts[(k + 1) % len(texts)]
        n = len(text) // 2
        for column, b in (("near_next", other), ("near_edited", text[:len(text) - n] + other[:n])):
            x, y = plain_lanes(text), plain_lanes(b)
            apart = sum((2 * (p - q) - (x[0] - y[0])) ** 2 for p, q in zip(x[1 + M.DENSE:], y[1 + M.DENSE:])) / M.SIGNS
            shared = (x[0] + y[0] - apart) / 2
            want = 1.0 if x == y else max(0.0, min(1.0, shared / max(x[0] + y[0] - shared, 1e-9)))
            assert math.isclose(got[k][column], want, abs_tol=1e-9), (k, column)


def grams(text):
    clean = text.translate(L._TABLE)
    out = set()
    for n, odd_ in ((2, 2654435761), (3, 2246822519), (4, 3266489917)):
        for k in range(len(clean) - n + 1):
            value = int.from_bytes(clean[k:k + n], "big") % 2**32
            out.add((value * odd_ % 2**32) >> 18)
    return out


def test_language_scores_are_those_of_a_direct_solve():
    random.seed(3)
    words = {"en": "the of and to in that was his".split(), "de": "der die und den von das nicht mit".split(), "fr": "le de la et les des en un".split()}
    rows = [(lang, " ".join(random.choices(own, k=random.randint(2, 12))).encode()) for lang, own in words.items() for _ in range(30)]
    model = L.fit(rows)
    marks = [grams(t) for lang in sorted(words) for other, t in rows if other == lang][:len(rows)]
    share = L.LANDMARKS // 3
    land = [g for lang in sorted(words) for g in [grams(t) for other, t in rows if other == lang][:share]]
    k = lambda a, b: len(a & b) / math.sqrt(max(len(a), 1) * max(len(b), 1))
    own = np.array([[k(a, b) for b in land] for a in land])
    values, vectors = np.linalg.eigh(own)
    whiten = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    phi = np.array([[k(grams(t), b) for b in land] for _, t in rows]) @ whiten
    target = np.array([[1.0 if lang == other else -1.0 for other in sorted(words)] for lang, _ in rows])
    w = np.sqrt(1 / 30)
    direct, *_ = np.linalg.lstsq(np.vstack([phi * w, math.sqrt(L.RIDGE) * np.eye(len(land))]), np.vstack([target * w, np.zeros((len(land), 3))]), rcond=None)
    want = phi @ direct
    got = L.kernel(L.presence([t for _, t in rows]), model.landmarks) @ model.coefficients
    assert len(marks) == len(rows) and np.allclose(got, want, atol=0.02)
    assert [model.languages[j] for j in want.argmax(axis=1)] == model.predict([t for _, t in rows])[0]


def test_registered_language_query_on_held_out_rows(spark, sf):
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = Q.queries()["op9_language_id"](spark, sf).collect()
    held = [r for r in got if r["held_out"] and docs[r["doc_id"]]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert len(got) == len(docs) and np.mean([r["lang_pred"] == docs[r["doc_id"]] for r in held]) >= 0.95


def test_registered_toxicity_query_on_held_out_labels(spark):
    sf_ = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_}/labels.parquet").collect()}
    got = Q.queries()["op8_toxicity"](spark, sf_).collect()
    held = [(r["predicted"], labels[r["doc_id"]], r["score"]) for r in got if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    assert len(held) > 20 and np.mean([p == t for p, t, _ in held]) >= 0.9
    toxic, clean = ([s for _, t, s in held if t == k] for k in (1, 0))
    auc = np.mean([(a > b) + (a == b) / 2 for a, b in product(toxic, clean)])
    assert auc >= 0.75, (auc, len(toxic), len(clean))


def test_viterbi_finds_the_best_of_all_readings():
    rng = np.random.default_rng(4)
    model = np.log(rng.dirichlet(np.ones(T.SIGNS), T.SIGNS**3)).astype(np.float32).reshape(-1)

    def score(ways):
        total, context = 0.0, (0, 0, 0)
        for letters, cost in ways:
            total -= cost
            for c in letters:
                k = T._SIGN.get(c, 27)
                total += model[((context[0] * T.SIGNS + context[1]) * T.SIGNS + context[2]) * T.SIGNS + k]
                context = (*context[1:], k) if k else (0, 0, 0)
        return total + model[((context[0] * T.SIGNS + context[1]) * T.SIGNS + context[2]) * T.SIGNS]

    random.seed(4)
    for _ in range(150):
        token = "".join(random.choice("abs1!0$.-eé33") for _ in range(random.randint(1, 7)))
        letters = [random.choice("amo1.$é") for _ in range(random.randint(1, 4))]
        for lattice in (T.readings(token), T.readings(token, cuts=True), T.readings(token, letterless=True), T.spaced_readings(letters)):
            paths = {}
            for ways in product(*lattice):
                text = "".join(x for x, _ in ways)
                paths[text] = max(paths.get(text, -math.inf), score(ways))
            got = T.likeliest(lattice, model)
            assert got in paths and math.isclose(paths[got], max(paths.values()), abs_tol=1e-3), (token, letters)
