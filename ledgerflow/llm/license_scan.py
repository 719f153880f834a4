"""License scans: phrases, and an exact set-similarity join with license templates.

A text's words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased; its tokens are
the pairs of neighbouring words, so what a template has in common with a text stands
there in its order. Blocks are windows of ``2 * STRIDE`` words every ``STRIDE`` words: a
template of up to ``STRIDE`` words that stands in the text stands whole in a block. A block
meets a template when it holds at least ``THRESHOLD`` of the template's distinct pairs. All
such pairs of block and template are found, without comparing each with each:

* global order: template pairs by how often the corpus has them, rarest first;
* length filter: a block with fewer template pairs than ceil(THRESHOLD * size) of every
  template is dropped;
* prefix filter: a template of s pairs that needs a of them must share one of its
  first s - a + 1; a join on those gives the candidates;
* positional filter: at the first shared pair, what is left of template and block must
  suffice;
* the candidates' overlap is counted.

Notices of one family differ in a word or two ("CC BY", "CC BY-NC"). Of met templates of a block
that have a pair in common, one goes if another has a larger containment, or the same one below
1 and more pairs; two that stand whole in the block both stay.

Phrases (``PHRASES``, two words or more) are places where their words stand in a row. A text is split
once: template and phrase pairs with their places are written to the shared folder, and all
the rest reads these. Everything is DataFrame expressions. Templates and phrases are ASCII, so
lower() stands for A-Z in all texts but those with one of the two signs whose lower case is or
holds an ASCII letter.

Null and empty texts have no words and no label; rows that share a doc_id are told apart, null ids,
too; an empty table gives no rows. Other columns are ignored. A text of any length is scanned whole.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import stored

#: Phrase and label.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Label and words of public license notices and of passages of license texts.
TEMPLATES = [
    ("all-rights-reserved", "all rights reserved"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
               "without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
            "documentation and or other materials provided with the distribution"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
            "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("public-domain", "this work has been released into the public domain"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
THRESHOLD = 0.8
STRIDE = 64
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str):
    """Array of the words of a text column."""
    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # KELVIN SIGN and I WITH DOT ABOVE: lower() makes ASCII of them
    odd = F.contains(own, F.lit("\u212a")) | F.contains(own, F.lit("\u0130"))
    return F.filter(F.split(F.when(odd, F.translate(own, UPPER, LOWER)).otherwise(F.lower(own)), NOT_WORD), lambda w: w != "")


def pairs_of(text: str) -> list[str]:
    """A template's or phrase's pairs of neighbouring words, in order."""
    words = text.split()
    return [" ".join(p) for p in zip(words, words[1:])]


def template_rows(templates) -> list[tuple[int, str, list[str], int]]:
    """Number, label, distinct pairs and pairs needed of each template."""
    out = []
    for k, (label, text) in enumerate(templates):
        pairs = list(dict.fromkeys(pairs_of(text)))
        if not text.isascii() or not pairs or len(text.split()) > STRIDE:
            raise ValueError(f"templates are ASCII, of 2 to {STRIDE} words: {text!r}")
        out.append((k, label, pairs, math.ceil(THRESHOLD * len(pairs) - 1e-9)))
    return out


def marked(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """uid, doc_id, n_words and marks, an array of (place, pair) of the pairs that templates or
    phrases have, of each row. Written to the shared folder."""
    if any(len(p.split()) < 2 for p, _ in phrases):
        raise ValueError("phrases have two words or more")
    known = sorted({p for _, text in [*templates] for p in pairs_of(text)} | {p for text, _ in phrases for p in pairs_of(text)})
    first = sorted({p.split()[0] for p in known})
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), words_of("text").alias("words"))
    pair = lambda w, i: F.concat(w, F.lit(" "), F.get("words", i + 1))  # noqa: E731  null at the last word
    some = F.transform("words", lambda w, i: F.when(w.isin(first), F.struct(i.alias("at"), pair(w, i).alias("pair"))))
    marks = F.filter(some, lambda m: m["pair"].isin(known))
    return stored(rows.select("uid", "doc_id", F.size("words").cast("long").alias("n_words"), marks.alias("marks")), "license-marks")


def pair_counts(rows: DataFrame) -> dict[str, int]:
    """How often the corpus has each marked pair: one row per pair of the templates."""
    found = rows.select(F.explode("marks.pair").alias("pair"))
    return {r["pair"]: r["n"] for r in found.groupBy("pair").agg(F.count("*").alias("n")).collect()}


def block_matches(rows: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(uid, block, template, label, containment) of all blocks of ``marked`` rows that meet a template."""
    spark, plain = rows.sparkSession, template_rows(templates)
    counts = pair_counts(rows)
    vocabulary = sorted({w for _, _, pairs, _ in plain for w in pairs}, key=lambda w: (counts.get(w, 0), w))
    order = {w: k for k, w in enumerate(vocabulary)}
    ordered = [(k, label, sorted(pairs, key=order.get), need) for k, label, pairs, need in plain]
    prefixes = spark.createDataFrame(
        [(w, k, label, pairs, need, j) for k, label, pairs, need in ordered for j, w in enumerate(pairs[:len(pairs) - need + 1])],
        "token string, template int, label string, pairs array<string>, need int, at int")
    least = min(need for *_, need in ordered)
    rare = sorted({w for _, _, pairs, need in ordered for w in pairs[:len(pairs) - need + 1]}, key=order.get)
    # a mark is in the block that begins in its stride and in the one before, if both its words are
    rows = rows.where((F.size("marks") >= least) & F.arrays_overlap("marks.pair", F.array(*map(F.lit, rare))))
    last = F.greatest(F.ceil(F.col("n_words") / STRIDE).cast("int") - 2, F.lit(0))
    placed = rows.select("uid", last.alias("last"), F.explode("marks").alias("m")).select("uid", "last", F.col("m.at").alias("i"), F.col("m.pair").alias("pair"))
    placed = placed.where(F.col("pair").isin(vocabulary))
    own = F.floor(F.col("i") / STRIDE).cast("int")
    both = F.array(own, F.when(F.pmod("i", F.lit(STRIDE)) != STRIDE - 1, own - 1))
    blocks = placed.select("uid", "last", "pair", F.explode(both).alias("block")).where((F.col("block") >= 0) & (F.col("block") <= F.col("last")))
    blocks = blocks.groupBy("uid", "block").agg(F.collect_set("pair").alias("own")).where(F.size("own") >= least)
    ranked = F.array_intersect(F.array(*map(F.lit, vocabulary)), F.col("own"))  # in the first array's order
    tokens = blocks.where(F.arrays_overlap("own", F.array(*map(F.lit, rare)))).select("uid", "block", ranked.alias("own"))
    tokens = tokens.select("uid", "block", "own", F.posexplode("own").alias("i", "token")).where(F.col("token").isin(rare))
    found = tokens.join(F.broadcast(prefixes), "token")
    rest = 1 + F.least(F.size("own") - F.col("i") - 1, F.size("pairs") - F.col("at") - 1)
    found = found.where(rest >= F.col("need")).withColumn("common", F.array_intersect("pairs", "own"))
    found = found.where((F.get("common", F.lit(0)) == F.col("token")) & (F.size("common") >= F.col("need")))
    return found.select("uid", "block", "template", "label", (F.size("common") / F.size("pairs")).alias("containment"))


def _related(templates) -> dict[int, list[tuple[int, bool]]]:
    """For each template those that share a pair with it, and whether they have more pairs."""
    rows = template_rows(templates)
    return {k: [(j, len(other) > len(own)) for j, _, other, _ in rows if j != k and set(own) & set(other)] for k, _, own, _ in rows}


def block_labels(met: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(uid, names, containment): labels of the met templates that stay, and the largest containment."""
    schema = "template int, rivals array<struct<template:int,longer:boolean>>"
    rivals = met.sparkSession.createDataFrame([(k, v) for k, v in _related(templates).items()], schema)
    rows = met.join(F.broadcast(rivals), "template")
    blocks = rows.groupBy("uid", "block").agg(F.collect_list(F.struct("template", "label", "containment", "rivals")).alias("met"))
    beaten = lambda m: F.exists("met", lambda o: F.exists(m["rivals"], lambda r: (r["template"] == o["template"]) & (
        (o["containment"] > m["containment"]) | ((o["containment"] == m["containment"]) & (m["containment"] < 1) & r["longer"]))))
    kept = F.filter("met", lambda m: ~beaten(m))
    blocks = blocks.select("uid", F.transform(kept, lambda m: m["label"]).alias("names"), F.array_max(F.transform("met", lambda m: m["containment"])).alias("containment"))
    return blocks.groupBy("uid").agg(F.array_distinct(F.flatten(F.collect_set("names"))).alias("names"), F.max("containment").alias("containment"))


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """Per row of ``docs``: phrase places, labels of phrases and templates, and a score:
    1 with a phrase, else the largest containment of a met template, else 0."""
    rows = marked(docs, templates, phrases)
    per_doc = block_labels(block_matches(rows, templates), templates)
    base = rows
    for k, (phrase, _) in enumerate(phrases):
        base = base.withColumn(f"at_{k}", _places(pairs_of(phrase)))
    every = F.array_sort(F.concat(*(f"at_{k}" for k in range(len(phrases)))))
    names = F.filter(F.array(*(F.when(F.size(f"at_{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(phrases))), lambda x: x.isNotNull())
    base = base.select("uid", "doc_id", "n_words", every.alias("places"), F.array_sort(F.array_distinct(names)).alias("base"))
    out = base.join(per_doc, "uid", "left")
    all_names = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("names", F.array().cast("array<string>")))))
    return out.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.get("places", F.lit(0)).cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join(all_names, ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"))


def _places(pairs: list[str]):
    """Places of ``marks`` where the pairs follow each other."""
    def here(m, i):
        hits = [(F.get("marks", i + j)["pair"] == p) & (F.get("marks", i + j)["at"] == m["at"] + j) for j, p in enumerate(pairs)]
        return F.coalesce(reduce(and_, hits), F.lit(False))

    return F.transform(F.filter("marks", here), lambda m: m["at"])
