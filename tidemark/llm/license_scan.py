"""License scan: an exact set-similarity join of text blocks with license templates.

A block matches a template T when at least ``threshold`` of T's distinct words occur in it (containment). Blocks are
runs of ``BLOCK`` consecutive words, starting every ``BLOCK / 2`` words, so every run of up to half a block lies
whole in some block. The words of all templates are ordered by how many documents of the corpus hold them, rarest
first, and both sides are sorted in that order. Then

* prefix filter: of T, a matching block must hold one of the first |T| - need + 1 words, where need is the least
  overlap. Documents and blocks without any such word are passed over, the others probe an index of these words;
* length filter: a block with fewer than ``need`` template words cannot match;
* positional filter: a shared word at position i of T and j of the block leaves at most
  1 + min(|T| - i - 1, |block| - j - 1) shared words from there on, which must reach ``need`` for the first shared
  word of the pair;
* what is left is verified by counting the overlap.

The number of templates is fixed, so the index and the word order are small by construction. All of it is built-in
column functions. A document with very many matching blocks spreads over tasks with its blocks' aggregation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

BLOCK, THRESHOLD = 64, 0.8

#: Phrases that are reported wherever their words stand consecutively, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Sentences by which public licenses are recognised, and their labels.
TEMPLATES = (
    ("agpl", "under the terms of the GNU Affero General Public License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights"),
    ("epl", "made available under the terms of the Eclipse Public License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee"),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mpl", "subject to the terms of the Mozilla Public License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

#: Letters outside ASCII whose lower case is, or begins with, an ASCII letter; they must not become one here.
_ODD, _KEPT = "Kİ", "ĸı"


def plain_words(text: Column) -> Column:
    """The words, with A-Z in lower case, joined by single blanks; empty without words.

    Other letters may change case as well, which changes neither the number of words nor any ASCII word.
    """
    odd = F.contains(text, F.lit(_ODD[0])) | F.contains(text, F.lit(_ODD[1]))
    lowered = F.lower(F.when(odd, F.translate(text, _ODD, _KEPT)).otherwise(text))
    return F.trim(F.regexp_replace(lowered, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " "))


def _distinct(phrase: str) -> list[str]:
    kept = "".join(c if c.isalnum() else " " for c in phrase.lower())
    return list(dict.fromkeys(kept.split()))


def _blanks(padded: Column) -> Column:
    return F.char_length(padded) - F.char_length(F.replace(padded, F.lit(" "), F.lit("")))


def phrase_places(words: Column, n_words: Column, phrase: str) -> tuple[Column, Column, Column]:
    """How often the phrase's words stand consecutively, and its first and last start (null without a place)."""
    size = len(phrase.split())
    padded = F.concat(F.lit(" "), words, F.lit(" "))
    parts = F.when(F.contains(padded, F.lit(f" {phrase} ")), F.split(padded, f"(?<= ){phrase}(?= )", -1))
    found = F.coalesce(F.size(parts) - 1, F.lit(0))
    first = _blanks(F.element_at(parts, 1)) - 1
    last = n_words - (_blanks(F.element_at(parts, -1)) - 1) - size
    return F.when(parts.isNull(), 0).otherwise(found), first, last


def word_order(words: DataFrame, vocabulary: list[str]) -> list[str]:
    """The template words, rarest first by the number of documents that hold them. One row per template word comes
    to the driver; their number is fixed by the templates."""
    held = F.array_intersect(F.split("words", " "), F.array(*map(F.lit, vocabulary)))
    counts = {r["w"]: r["n"] for r in words.select(F.explode(held).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def blocks_of(rows: DataFrame, block: int) -> DataFrame:
    """row, start, ranks: per block its distinct template words as ascending ranks. ``rows``: row, words (array), order."""
    last = F.greatest(F.lit(0), F.ceil((F.size("words") - block) / (block // 2)).cast("int"))
    starts = F.transform(F.sequence(F.lit(0), last), lambda i: i * (block // 2))
    cut = rows.select("row", "words", F.explode(starts).alias("start"))
    return cut.select("row", "start", F.slice("words", F.col("start") + 1, F.lit(block)).alias("block"))


def join_templates(rows: DataFrame, order: list[str], templates=TEMPLATES, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """row, start, label, containment of every block and template that reach the threshold."""
    spark, rank = rows.sparkSession, {w: i for i, w in enumerate(order)}
    sorted_templates = []
    for number, (label, phrase) in enumerate(templates):
        ranks = sorted(rank[w] for w in _distinct(phrase))
        sorted_templates.append((number, label, ranks, math.ceil(threshold * len(ranks) - 1e-9)))
    index = [(r, i, n, label, ranks, need) for n, label, ranks, need in sorted_templates for i, r in enumerate(ranks[: len(ranks) - need + 1])]
    index = spark.createDataFrame(index, "rank int, i int, template int, label string, t_ranks array<int>, need int")
    ordered = F.array(*map(F.lit, order))
    blocks = blocks_of(rows, block)
    held = F.array_intersect("block", ordered)
    ranks = F.array_sort(F.transform(held, lambda w: F.array_position(ordered, w).cast("int") - 1))
    blocks = blocks.select("row", "start", ranks.alias("ranks"))
    probes = blocks.select("row", "start", "ranks", F.posexplode("ranks").alias("j", "rank")).join(index, "rank")
    shared = F.size(F.array_intersect("ranks", "t_ranks"))
    first_shared = F.array_min(F.array_intersect("ranks", "t_ranks")) == F.col("rank")
    room = 1 + F.least(F.size("t_ranks") - F.col("i") - 1, F.size("ranks") - F.col("j") - 1)
    passed = probes.where((F.size("ranks") >= F.col("need")) & (room >= F.col("need")))
    hits = passed.where(first_shared & (shared >= F.col("need")))
    return hits.select("row", "start", "template", "label", (shared / F.size("t_ranks")).alias("containment"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    Null and empty texts have no words, no labels and score 0. Rows that repeat an id are scanned each. ``blocks``
    lists (start word, label, containment) of matching blocks, null without any; score is 1 where a phrase stands,
    else the highest containment found. Other columns are left out.
    """
    scratch = common.Scratch(docs.sparkSession, "license-scan")
    words = docs.select(F.col(doc_id).alias("doc_id"), plain_words(F.coalesce(F.col(text), F.lit(""))).alias("words"))
    vocabulary = sorted({w for _, phrase in templates for w in _distinct(phrase)})
    order = word_order(words, vocabulary)
    rank, prefix = {w: i for i, w in enumerate(order)}, set()
    for _, phrase in templates:
        ordered = sorted(_distinct(phrase), key=rank.get)
        prefix |= set(ordered[: len(ordered) - math.ceil(threshold * len(ordered) - 1e-9) + 1])

    base = words.withColumn("n_words", F.when(F.col("words") == "", 0).otherwise(_blanks(F.col("words")) + 1))
    places = {label: phrase_places(F.col("words"), F.col("n_words"), phrase) for phrase, label in PHRASES.items()}
    base = base.select(
        "doc_id", "n_words", "words", F.monotonically_increasing_id().alias("row"),
        F.array(*[F.struct(n.alias("n"), a.alias("a"), z.alias("z"), F.lit(label).alias("label")) for label, (n, a, z) in places.items()]).alias("places"),
    )
    listed = F.split("words", " ")
    base = scratch.keep(base.select(
        "doc_id", "row", "n_words", F.filter("places", lambda p: p["n"] > 0).alias("places"),
        F.when(F.arrays_overlap(listed, F.array(*map(F.lit, sorted(prefix)))), listed).alias("words"),
    ), "base")

    hits = join_templates(base.where("words is not null").select("row", "words"), order, templates, threshold, block)
    found = hits.groupBy("row").agg(
        F.collect_set("label").alias("more"), F.max("containment").alias("best"),
        F.sort_array(F.collect_list(F.struct("start", "label", "containment"))).alias("blocks"),
    )
    own = F.transform("places", lambda p: p["label"])
    out = base.drop("words").join(found, "row", "left")
    return out.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"),
        F.aggregate("places", F.lit(0), lambda n, p: n + p["n"]).cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["a"])).cast("long").alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["z"])).cast("long").alias("last_word"),
        F.array_join(F.array_sort(own), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(own, F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"), "blocks",
    )
