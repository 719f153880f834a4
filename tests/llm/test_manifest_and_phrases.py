"""Hash tree, collocations and secret scan against plain Python."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from llm_cases import nothing, odd  # noqa: F401  fixtures
from ledgerflow.llm import collocations, merkle_manifest, secret_scan


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def tree(nodes):
    """Root, and each leaf's siblings (before, after) level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            s = p // 3 * 3
            paths[i].append(("".join(nodes[s:p]), "".join(nodes[p + 1:s + 3])))
            at[i] = p // 3
        nodes = [H("".join(nodes[k:k + 3])) for k in range(0, len(nodes), 3)]
    return nodes[0], paths


def manifest(rows):
    f = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: H(f(r["doc_id"]) + f(r["source"]) + f(r["lang"]) + f(r["n_chars"]) + f(t))
    sources = defaultdict(list)
    for r in rows:
        sources[r["source"]].append(((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])), r))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        sources[s].sort(key=lambda x: x[0])
        trees[s] = tree([key[2] for key, _ in sources[s]])
    root, upper = tree([trees[s][0] for s in names])
    out = []
    for s, above in zip(names, upper):
        for ((_, _, own), r), path in zip(sources[s], trees[s][1]):
            t = own
            if r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                t = leaf(r, r["text"].replace("\n", ""))
            for x, y in path + above:
                t = H(x + t + y)
            out.append((r["doc_id"], own, trees[s][0], root, H("".join(x + y for x, y in path + above)), t, t == root))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


def test_manifest_is_that_of_plain_python(spark, odd, nothing, monkeypatch):
    random.seed(5)
    rows = [(random.choice([k, k, 7, None]), "a\nb" * random.randint(0, 3) if k % 7 else None, "en", random.choice(["", "x", "x", "x", "é", None] + ["s%d" % (k % 13)]), k)
            for k in range(400)]
    many = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    for depth in (6, 1, 2):  # whole trees in a block, and several rounds of blocks
        monkeypatch.setattr(merkle_manifest, "DEPTH", depth)
        monkeypatch.setattr(merkle_manifest, "BLOCK", 3 ** depth)
        for docs in (odd, many):
            got = [tuple(r) for r in merkle_manifest.verified(docs).collect()]
            assert sorted(got, key=key) == sorted(manifest(docs.collect()), key=key)
    assert merkle_manifest.verified(nothing).count() == 0
    one = spark.createDataFrame([(1, "t", "en", "s", 1)], many.schema)
    assert [tuple(r) for r in merkle_manifest.verified(one).collect()] == manifest(one.collect())


def test_a_changed_row_is_found_and_others_are_not(spark):
    docs = spark.createDataFrame([(k, "x\ny", None, "s", 3) for k in range(50)], "doc_id long, text string, lang string, source string, n_chars long")
    out = merkle_manifest.manifest(docs, F.when(F.col("doc_id") == 17, "x y"))
    out = out.select("doc_id", (merkle_manifest.folded(F.coalesce("changed_leaf", "leaf"), F.col("path")) == F.col("root")).alias("ok")).collect()
    assert [r["doc_id"] for r in out if not r["ok"]] == [17]


def phrases_of(rows):
    """All steps of the collocations by plain counting."""
    f = defaultdict(Counter)
    for r in rows:
        text = (r["text"] or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            for m in (1, 2, 3, 4):
                f["und" if r["lang"] is None else r["lang"]].update(tuple(w[k:k + m]) for k in range(len(w) - m + 1))
    out = []
    for lang, n in f.items():
        total = sum(v for p, v in n.items() if len(p) == 1)
        candidates = {p: v for p, v in n.items() if len(p) > 1 and v >= 30}
        kept = []
        for p, a in candidates.items():
            inside = lambda q: any(q[k:k + len(p)] == p for k in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and 100 * b >= 80 * a and inside(q) for q, b in candidates.items()):
                continue
            score, _, left, right = min((2000000 * a // (n[p[:k]] + n[p[k:]]), k, n[p[:k]], n[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:2000], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total, -score))
    return out


def test_collocations_are_those_of_plain_counting(spark, odd, nothing, monkeypatch):
    random.seed(9)
    words = ["a", "B", "cé", "日", "\x85x", "e.f", "g,", "h!\n", "i\tj", "k-l"]
    rows = [(k, " ".join(random.choices(words, weights=[40, 20, 10, 9, 5, 4, 3, 3, 2, 1], k=random.randint(0, 400))), random.choice(["en", "en", "de", None])) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    want = sorted(phrases_of(docs.collect()))
    assert len(want) > 100
    assert sorted(map(tuple, collocations.collocations(docs).collect())) == want
    monkeypatch.setattr(collocations, "COUNT_BYTES", 200)  # texts are read in many parts
    monkeypatch.setattr(collocations, "PARTS", 7)          # few parts, most stripes in several
    assert sorted(map(tuple, collocations.collocations(docs).collect())) == want
    assert sorted(map(tuple, collocations.collocations(odd).collect())) == sorted(phrases_of(odd.collect()))
    assert collocations.collocations(nothing).count() == 0


PATTERNS = [(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), ("AKIA[A-Z0-9]+", 0, 18), ("[0-9a-f]+", 0, 16)]


def base_spans(text):
    out = [(m.start(), k, m.end()) for k, (p, group, least) in enumerate(PATTERNS) for m in re.finditer(p, text or "") if len(m[group]) >= least]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_base_secrets_are_those_of_plain_patterns(spark, odd, nothing):
    random.seed(2)
    bits = ["password", "PassWd", "ſecret", "toKen", "toKen", "api_key", "APIKEY", ": ", "=", " ", "\"", "'", "abcdefghijkl", "0123456789abcdef", "AKIA", "AKIAABCDEFGH012345", "é", "😀",
            "x.y=z", "\n", "-", "ABCDEF", "secret=token=aaaaaaaaaaaaaaaa", "deadbeef"]
    texts = ["".join(random.choices(bits, k=random.randint(0, 25))) for _ in range(500)] + [None, "", "token: secret: abcdefghijklmnop"]
    docs = spark.createDataFrame([(k // 2, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    for table in (docs, odd):
        got = [(r["doc_id"], r["base_sha256"], r["n_assign"], r["n_access"], r["n_hex"]) for r in secret_scan.scan(table).collect()]
        want = [(r["doc_id"], H(s := base_spans(r["text"])), s.count("assign"), s.count("access"), s.count("hex")) for r in table.collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
    assert secret_scan.scan(nothing).count() == 0


def test_random_runs_are_found_and_ordinary_ones_are_not(spark):
    random.seed(3)
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    ordinary = "the rain in the mountains goes on and on while people of the town are waiting for better weather and warmer days to come back "
    rows = []
    for k in range(120):
        words = random.sample(ordinary.split() * 20, 200)
        run = "".join(random.choices(base64, k=44)) if k % 3 == 0 else "".join(words[:12])[:44] if k % 3 == 1 else "0123456789ABCDEF" * 3
        rows.append((k, " ".join(words[:100] + [run] + words[100:])))
    out = {r["doc_id"]: r for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(out[k]["n_random"] for k in range(0, 120, 3)) >= 36
    assert sum(out[k]["n_random"] for k in range(1, 120, 3)) <= 2
    assert sum(out[k]["n_random"] for k in range(2, 120, 3)) == 0
    for k, r in out.items():
        for s in filter(None, r["spans"].split(",")):
            kind, a, b = s.split(":")
            assert kind == "random" and re.fullmatch(r"[A-Za-z0-9+/_-]{20,}=*", rows[k][1][int(a):int(b)])
