import collections
import itertools
import random
import re

import numpy as np
import pyarrow as pa

from llm_cases import nothing, odd  # noqa: F401  fixtures
from ledgerflow.llm import decontaminate, license_scan, ngram_join, paragraph_dedup
from ledgerflow.llm.common import alnum_words, blank_words


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = blank_words((t or "").encode())
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies():
    random.seed(2)
    words, rows = [f"w{k}" for k in range(3000)], []
    for _ in range(6):
        base = [random.choice(words) for _ in range(random.choice([6, 30, 90]))]
        for _ in range(30):
            w = list(base)
            for _ in range(random.randint(0, 3)):
                w[random.randrange(len(w))] = random.choice(words)
            rows.append((3 * len(rows) + 1, " ".join(w[:random.randint(1, len(w))] if random.random() < 0.3 else w)))
    return rows + [(100000, None), (100001, ""), (100002, "a b"), (100003, "A  B"), (100004, "  ")]


def test_ngram_join_is_exact_in_one_group_and_in_blocks(spark, monkeypatch):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_components(rows)
    monkeypatch.setattr(ngram_join, "GROUP_DOCS", 7)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.cluster(docs).collect()}
    assert got == want
    kept = {r["doc_id"] for r in ngram_join.keep_one_of_each(docs).collect()}
    assert kept == {c for _, c in want.values()}


def test_trie_groups_against_all_pairs():
    import numpy as np
    random.seed(1)
    for _ in range(100):
        m = random.randint(2, 25)
        base = [random.sample(range(60), random.randint(1, 30)) for _ in range(4)]
        sets = [set(random.choice(base)) ^ set(random.sample(range(70), random.randint(0, 5))) or {99} for _ in range(m)]
        blocks = [random.randint(0, 1) for _ in sets]
        for apart in (False, True):
            got = ngram_join.group_links(list(range(m)), blocks, [np.array(sorted(s), np.uint64).tobytes() for s in sets], apart)
            want = {(a, b) for a, b in itertools.combinations(range(m), 2) if (not apart or blocks[a] != blocks[b])
                    and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
            assert {(min(e), max(e)) for e in got} <= want
            joined = list(range(m))
            for a, b in got:
                joined = [joined[a] if x == joined[b] else x for x in joined]
            assert all(joined[a] == joined[b] for a, b in want)


def test_ngram_join_of_odd_rows(odd, nothing):
    got = ngram_join.cluster(odd).collect()
    assert len(got) == odd.count()
    assert all((r["component_id"] is None) == (r["doc_id"] is None) for r in got)
    assert ngram_join.cluster(nothing).count() == 0
    assert ngram_join.keep_one_of_each(odd).columns == odd.columns


def test_repeated_rows_and_null_ids_are_kept_once(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(n)) for x, n in (("a", 40), ("b", 60), ("c", 40)))
    rows = [(1, a, "x"), (1, a, "x"), (1, a, "y"), (1, b, "x"), (None, c, "x"), (None, c, "x"), (None, c + " more", "x"), (None, a, "x"),
            (5, a, "x"), (None, None, "x"), (None, None, "x"), (6, None, "x"), (7, "", "x"), (8, "", "x")]
    for n in (1, 5):  # in any order
        docs = spark.createDataFrame(rows[::-1] if n == 1 else rows, "doc_id long, text string, lang string").repartition(n)
        got = sorted(((r["doc_id"], r["text"], r["lang"]) for r in ngram_join.keep_one_of_each(docs).collect()), key=str)
        null = [t for d, t, _ in got if d is None and t]
        assert len(null) == 1 and null[0] in (c, c + " more")
        assert [r for r in got if not (r[0] is None and r[1])] == sorted(
            [(1, a, "x"), (1, b, "x"), (None, None, "x"), (6, None, "x"), (7, "", "x"), (8, "", "x")], key=str)


def test_paragraphs_find_passages_inside_lines_and_leave_others(spark, odd, nothing):
    random.seed(2)
    words = [f"w{k}" for k in range(5000)]
    passages = [[random.choice(words) for _ in range(51)] for _ in range(4)]
    rows = []
    for i in range(60):
        w = [random.choice(words) for _ in range(random.randint(0, 150))]
        if i % 3 == 0:
            k = random.randint(0, len(w))
            w[k:k] = passages[i // 3 % 4]
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame([*rows, (100, None), (None, " ".join(passages[0]))], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in paragraph_dedup.cluster(docs).collect()}
    for i in range(60):
        assert (got[i]["n_repeated"] > 0) == (i % 3 == 0)
        assert got[i]["component_id"] == (i // 3 % 4 * 3 if i % 3 == 0 else i)
        # a paragraph that reaches a few words beyond the passage is near enough, too
        assert got[i]["removed_words"] <= got[i]["repeated_words"] <= 51 + 16
    left = {r["doc_id"]: r["text"] for r in paragraph_dedup.remove_repeats(docs).collect()}
    assert left[0] == rows[0][1] and len(left[57].split()) < len(rows[57][1].split())
    assert len(paragraph_dedup.cluster(odd).collect()) == odd.count()
    assert paragraph_dedup.remove_repeats(odd).columns == odd.columns and len(paragraph_dedup.remove_repeats(odd).collect()) == odd.count()
    assert paragraph_dedup.cluster(nothing).count() == 0


def test_paragraph_recall_near_the_threshold():
    """Band keys of paragraphs with one changed end word collide as often as planned."""
    random.seed(4)
    hit = 0
    for _ in range(200):
        while True:  # 32 words are a paragraph if the first has the smallest hash of 16
            w = [f"w{random.randrange(10**6)}" for _ in range(32)]
            own = paragraph_dedup.Paragraphs([" ".join(w).encode(), " ".join([*w[:30], "other", "end"]).encode()])
            if len(own.hash) == 2:
                break
        keys = own.keys(paragraph_dedup.bands())
        hit += bool((keys[0] == keys[-1]).any())
    assert hit >= 190


def test_exact_copies_of_any_length_repeat(spark):
    """Lines, blocks and whole texts are paragraphs, however short; nothing is drawn again."""
    random.seed(12)
    fresh = lambda n: " ".join(f"w{random.randrange(10**9)}" for _ in range(n))
    rows, lines = [], {}
    for k, n in enumerate((1, 3, 20, 32, 46)):
        own = fresh(n)
        rows += [(100 * k + 1, own), (100 * k + 2, own), (100 * k + 3, fresh(9) + "\n" + own + "\n" + fresh(40))]
        lines[k] = n
    block = fresh(2) + "\n" + fresh(3)
    rows += [(901, fresh(7) + "\n\n" + block + "\n\n" + fresh(8)), (902, block.replace("\n", " ")), (950, fresh(3)), (951, fresh(60)), (952, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in paragraph_dedup.cluster(docs).collect()}
    for k, n in lines.items():
        for j in (1, 2, 3):
            r = got[100 * k + j]
            # a window that reaches a few words beyond the line is near enough, too
            assert r["n_repeated"] > 0 and n <= r["repeated_words"] <= n + 16 and r["component_id"] == 100 * k + 1, (n, j, r)
            assert r["removed_words"] == (r["repeated_words"] if j > 1 else 0)
    assert got[901]["repeated_words"] == got[902]["removed_words"] == 5
    assert all(got[k]["n_repeated"] == 0 and got[k]["component_id"] == k for k in (950, 951, 952))
    left = {r["doc_id"]: r["text"] for r in paragraph_dedup.remove_repeats(docs).collect()}
    assert all(left[100 * k + 2] == "" and 33 <= len(left[100 * k + 3].split()) <= 49 for k in lines)


def test_recall_of_near_paragraphs_with_changes_spread_over_them(spark):
    """Lines of Jaccard 0.75 to 0.85 by brute force are found whole, in other texts."""
    random.seed(13)
    fresh = lambda n: [f"w{random.randrange(10**9)}" for _ in range(n)]
    grams = lambda w: {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
    pairs, rows = {}, []
    while len(pairs) < 200:
        a = fresh(random.randint(60, 250))
        b, n = list(a), max(1, round(len(a) * random.uniform(0.015, 0.03)))
        for j in range(n):
            b[(2 * j + 1) * len(a) // (2 * n)] = fresh(1)[0]
        if 0.75 <= len(grams(a) & grams(b)) / len(grams(a) | grams(b)) <= 0.85:
            k = len(pairs)
            pairs[k] = len(b)
            rows += [(2 * k + j, "\n".join(" ".join(x) for x in (fresh(30), w, fresh(50)))) for j, w in enumerate((a, b))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in paragraph_dedup.cluster(docs).collect()}
    found = sum(got[2 * k + 1]["removed_words"] >= n for k, n in pairs.items())
    assert found >= 0.95 * len(pairs), found
    assert all(got[2 * k]["removed_words"] == 0 for k in pairs)


def brute_hits(docs, items, n=10):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = alnum_words((text or "").encode())
        size = min(n, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            windows[tuple(w[k:k + size])].add(str(item))
    out = []
    for doc, text in docs:
        w = alnum_words((text or "").encode())
        hit, found = set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                owners = windows.get(tuple(w[k:k + size]))
                if owners:
                    found |= owners
                    hit |= set(range(k, k + size))
        out.append((doc, len(w), len(hit), len(found), decontaminate.digest(found), bool(hit)))
    return sorted(out, key=str)


def test_decontamination_is_brute_force_s_broadcast_and_joined(spark):
    random.seed(6)
    words = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(random.choice(words) for _ in range(random.choice([0, 1, 4, 10, 14, 30])))) for k in range(12)] + [(99, None)]
    docs = []
    for k in range(80):
        w = [random.choice(words) for _ in range(random.randint(0, 60))]
        if k % 3 == 0:
            at = random.randint(0, len(w))
            w[at:at] = (random.choice(items)[1] or "").split()[:random.randint(5, 30)]
        docs.append((k, random.choice([" ", ", ", "\n"]).join(w).upper() if k % 2 else " ".join(w)))
    docs += [(500, None), (501, ""), (502, "...!"), docs[3], docs[3]]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute_hits(docs, items)
    rows = lambda out: sorted(map(tuple, out.collect()), key=str)
    assert rows(decontaminate.find_hits(d, b)) == want
    assert rows(decontaminate.find_hits(d, b, bound=5)) == want
    one, many = (sorted(map(tuple, decontaminate.remove_hits(d, b, bound=k).collect()), key=str) for k in (10**6, 5))
    assert one == many
    hit = {r[0]: r for r in want}
    assert {r[0] for r in one} == {r[0] for r in want if r[2] < 0.5 * r[1] or not r[2]}
    for doc, text in one:
        assert len(alnum_words((text or "").encode())) == hit[doc][1] - hit[doc][2]


def test_decontamination_of_odd_rows(spark, odd, nothing):
    b = spark.createDataFrame([(1, "brown fox jumps"), (None, "lazy dog"), (3, "")], "item_id long, text string")
    assert decontaminate.find_hits(odd, b).where("n_hit = 5").count() == 4
    assert decontaminate.find_hits(odd, b.limit(0)).where("contaminated").count() == 0
    assert decontaminate.find_hits(nothing, b).count() == 0
    for bound in (10**6, 3):  # a broadcast benchmark, and one that is joined
        out = decontaminate.remove_hits(odd, b, bound=bound)
        assert out.columns == odd.columns and "lazy" not in "".join(r["text"] or "" for r in out.collect())
        assert decontaminate.find_hits(odd, b, bound=bound).where("n_hit = 5").count() == 4
        assert decontaminate.find_hits(nothing, b, bound=bound).count() == decontaminate.remove_hits(nothing, b, bound=bound).count() == 0


def test_license_scan_finds_phrases_and_templates(spark, odd, nothing):
    texts = ["Released under the MIT License. mit  license!", "x " * 40 + "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0",
             "This is mit. License", "GNU GENERAL PUBLIC LICENSE " * 2, "mİt license", "permission is granted, free of charge", "apache licensed"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    assert (got[0]["n_base"], got[0]["first_word"], got[0]["last_word"], got[0]["labels"], got[0]["score"]) == (2, 3, 5, "mit", 1.0)
    assert (got[1]["labels"], got[1]["base_labels"], got[1]["n_words"], got[1]["score"]) == ("cc-by-nc", "", 47, 1.0)
    assert got[2]["labels"] == "cc-by" and got[3]["n_base"] == 1
    assert (got[4]["base_labels"], got[4]["n_base"]) == ("gpl", 2)
    assert got[5]["n_base"] == 0 and got[6]["labels"] == "" and got[7]["n_base"] == 0
    out = license_scan.scan(odd).collect()
    assert len(out) == odd.count()
    assert sum(r["labels"] == "all-rights-reserved" for r in out) == 4
    assert license_scan.scan(nothing).count() == 0


#: Texts and the labels a reader gives them.
NOTICES = [
    ("Licensed under CC BY 4.0", "cc-by"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("licensed under CC-BY-SA 4.0", "cc-by-sa"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa"),
    ("Released under the Apache License", "apache"), ("released under the GPL license", ""), ("Released under the MIT license", "mit"),
    ("He reserved all the rights of the house", ""), ("All rights reserved", "all-rights-reserved"), ("rights reserved, all of them", ""),
    ("mit der Apache License, released under the terms, mit license", "apache,mit"), ("er kam mit uns, released under the old license", ""),
    ("Licensed under CC BY 4.0, pictures licensed under CC BY-NC 4.0", "cc-by,cc-by-nc"),
    ("This work is licensed under the GNU General Public License, version 3", "gpl"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser Public License", "gpl"),
    ("This is free and unencumbered software released into the public domain", "unlicense"), ("This work has been released into the public domain", "public-domain"),
    ("permission is granted, free of charge, to any person", ""), ("subject to the terms of the Mozilla Public License, v. 2.0", ""),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl"),
    ("without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
     "and to permit persons to whom the Software is furnished to do so, subject to the following conditions", "mit"),
    ("by 0 cc the under 4 licensed", ""), ("under the mit", ""), ("the use of source and binary forms", ""),
]


def test_notices_have_the_labels_a_reader_gives_them(spark):
    pad = "word " * 90
    docs = spark.createDataFrame([(k, f"{a}{t} {b}") for k, (t, _) in enumerate(NOTICES) for a, b in (("", ""), (pad, pad), (pad[:-25], ""))], "doc_id long, text string")
    out = license_scan.scan(docs).collect()
    assert len(out) == 3 * len(NOTICES)
    assert [(NOTICES[r["doc_id"]][0], r["labels"]) for r in out if r["labels"] != NOTICES[r["doc_id"]][1]] == []


def test_license_join_is_brute_force_s(spark):
    random.seed(8)
    words = sorted({w for _, t in license_scan.TEMPLATES for w in t.split()}) + ["x", "y", "z"]
    docs = []
    for k in range(60):
        w = [random.choice(words) for _ in range(random.randint(0, 120))]
        t = random.choice(license_scan.TEMPLATES)[1].split()
        at = random.randint(0, len(w))
        w[at:at] = [x for x in t if random.random() < 0.95]
        docs.append((k, " ".join(w)))
    rows = license_scan.marked(spark.createDataFrame(docs, "doc_id long, text string"))
    met = license_scan.block_matches(rows).join(rows.select("uid", "doc_id"), "uid")
    got = {(r["doc_id"], r["block"], r["template"]) for r in met.collect()}
    want = set()
    stride = license_scan.STRIDE
    for k, text in docs:
        w = re.findall(r"\w+", text)
        for b in range(max(-(-len(w) // stride) - 2, 0) + 1):
            block = w[stride * b:stride * (b + 2)]
            own = {" ".join(p) for p in zip(block, block[1:])}
            want |= {(k, b, j) for j, _, t, need in license_scan.template_rows(license_scan.TEMPLATES) if len(own & set(t)) >= need}
    assert got == want and len(want) > 20


def test_few_sets_are_linked_as_by_the_prefix_tree():
    random.seed(21)
    for m in (2, 3, 8, 20):
        for apart in (False, True):
            base = [random.sample(range(1, 400), 40) for _ in range(3)]
            sets = [np.unique(np.array([x if random.random() < 0.93 else random.randint(1, 400) for x in random.choice(base)], np.uint64)) for _ in range(m)]
            blocks = [random.randint(0, 1) for _ in range(m)]
            args = (list(range(m)), blocks, [s.tobytes() for s in sets], apart)

            def joined(found):
                root = list(range(m))
                for a, b in found:
                    root = [root[a] if x == root[b] else x for x in root]
                return {(a, b) for a in range(m) for b in range(a) if root[a] == root[b]}

            assert joined(paragraph_dedup.pair_links(*args)) == joined(ngram_join.group_links(*args))


def test_prefixes_connect_what_every_comparison_connects(monkeypatch):
    random.seed(23)
    for case in range(60):
        monkeypatch.setattr(paragraph_dedup, "DENSE", 0 if case % 2 else 1 << 25)
        monkeypatch.setattr(paragraph_dedup, "COMPARED", 50 if case % 3 else 1 << 19)
        m, sets = random.randint(25, 70), []
        for k in range(m):  # chains of copies, with some of their shingles changed, of many sizes
            near = set(random.choice(sets)) if sets and random.random() < 0.7 else set(random.sample(range(300), random.randint(1, 40)))
            for x in random.sample(sorted(near), min(len(near) - 1, random.randint(0, 4))):
                near.discard(x)
            sets.append(near | set(random.sample(range(300), random.randint(0, 3))))
        blocks = [random.randint(0, 1) for _ in sets]
        for apart in (False, True):
            root = list(range(m))
            for k in range(m):
                for j in range(k):
                    if 100 * len(sets[k] & sets[j]) >= 75 * len(sets[k] | sets[j]) and not (apart and blocks[k] == blocks[j]):
                        root = [root[j] if r == root[k] else r for r in root]
            found = paragraph_dedup.prefix_links(list(range(m)), blocks, [np.array(sorted(s), np.uint64).tobytes() for s in sets], apart)
            assert len(found) == m - len(set(root)) and all(root[a] == root[b] for a, b in found)
            assert not apart or all(blocks[a] != blocks[b] for a, b in found)


def test_a_group_of_many_unlike_windows_is_compared_at_once(monkeypatch):
    monkeypatch.setattr(ngram_join, "Trie", None)
    sets = [np.array([*range(9), *range(100 * k + 20, 100 * k + 39)], np.uint64).tobytes() for k in range(1, 300)]
    copies = [np.array([*range(9), *range(100 * k + 20, 100 * k + 38), 9], np.uint64).tobytes() for k in range(1, 300)]
    found = paragraph_dedup.pair_links(list(range(598)), [0] * 598, sets + copies, False)
    assert sorted((min(x), max(x)) for x in found) == [(k, k + 299) for k in range(299)]


class Captured:
    """Stands for a DataFrame, and keeps the functions that would run on its batches."""

    def __init__(self):
        self.runs = []

    def first(self):
        return [10**8]

    def mapInArrow(self, run, schema):
        self.runs.append(run)
        return self

    def __getattr__(self, name):
        return lambda *a, **b: self


def test_groups_send_their_links_together(spark):
    rows = Captured()
    ngram_join.links(rows, rows, paragraph_dedup.pair_links, chosen=True)
    groups, ids = np.repeat(np.arange(500), 4), np.arange(2000)[::-1].copy()
    sets = [(np.arange(30, dtype=np.uint64) + np.uint64(100 * g)).tobytes() for g in groups]
    columns = [pa.array(groups), pa.array([0] * 2000, pa.int32()), pa.array([0] * 2000, pa.int32()), pa.array(ids), pa.array([0] * 2000, pa.int32()), pa.array(sets, pa.binary())]
    batch = pa.RecordBatch.from_arrays(columns, ["leader", "i", "j", "doc_id", "block", "body"])
    out = list(rows.runs[0](iter([batch])))
    assert len(out) == 1  # not a batch for each group
    got = sorted(zip(out[0].column("a").to_pylist(), out[0].column("b").to_pylist()))
    assert got == [(a, a + k) for a in range(0, 2000, 4) for k in (1, 2, 3)]


def test_a_chunk_sends_its_keys_for_all_parts_together(spark):
    texts = [" ".join(f"w{(7 * k + j) % 997}" for j in range(200)) for k in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(texts)], ["doc_id", "text"])
    for make in (lambda rows: paragraph_dedup.band_counts(rows, paragraph_dedup.bands()), ngram_join.half_counts):
        rows = Captured()
        make(rows)
        out = list(rows.runs[0](iter([batch])))
        parts = [p for b in out for p in b.column("part").to_pylist()]
        assert len(out) == 2 and parts[0] == -1 and len(set(parts)) == len(parts) > 8  # the rows' and the keys'


def test_stars_connect_what_links_connect():
    rng = random.Random(8)
    for n in (0, 1, 5, 40):
        found = [(rng.randrange(50), rng.randrange(50)) for _ in range(n)]
        assert components_of(ngram_join.stars(found)) == components_of(found)
    assert sorted(ngram_join.stars([(9, 4), (4, 7), (7, 9), (2, 3)])) == [(2, 3), (4, 7), (4, 9)]


def components_of(links):
    groups = {x: {x} for link in links for x in link}
    for a, b in links:
        both = groups[a] | groups[b]
        groups.update(dict.fromkeys(both, both))
    return sorted({tuple(sorted(g)) for g in groups.values() if len(g) > 1})


def test_paragraph_keys_do_not_depend_on_the_texts_made_at_once(spark):
    texts = [("word%d " % k) * 40 + " ".join(f"w{(k * j) % 89}" for j in range(120)) for k in range(60)] + ["", "x" * 300_000 + " y"]
    n_words, n, keys = paragraph_dedup._keys_of([t.encode() for t in texts], 5)
    some = [paragraph_dedup._keys_of([t.encode() for t in texts[a:b]], 5) for a, b in ((0, 7), (7, 8), (8, 62))]
    assert n_words.tolist() == np.concatenate([x[0] for x in some]).tolist() == [len(t.split()) for t in texts]
    assert n.tolist() == np.concatenate([x[1] for x in some]).tolist()
    assert sorted(keys.tolist()) == sorted(np.concatenate([x[2] for x in some]).tolist())
