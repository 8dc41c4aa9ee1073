"""License scan: exact set-similarity join of text blocks with license templates.

A template is one characteristic sentence of a license; a block is a passage of a paragraph (text between blank lines),
as many words long as the template's words may be spread over: their number over ``threshold``, rounded up. A text
carries a template's label if one of its passages holds at least ``threshold`` of the template's distinct words.
The join is exact and filtered, paragraphs first: only words that stand in some template can add to an overlap, so
paragraphs shrink to these; words are ordered by their frequency over the paragraphs of the whole corpus, rarest
first; and a pair is a candidate only if a word of the paragraph's prefix meets one of the template's prefix, if the
paragraph has words enough (length filter), and if what is left after the meeting point can still reach the threshold
(positional filter). Survivors are confirmed on the full sets, then passage by passage on the words in their order.
Only paragraphs that hold a word of some template's prefix are read for that, and only those are ever shuffled.

Templates are a parameter of at most ``MAX_TEMPLATES`` sentences, so what is collected (a frequency for each
of their words) and broadcast (their prefixes) has a fixed bound. All steps are native columns.

Defined results: null or empty texts have no words, no labels and score 0; repeated rows of one id are
scanned one by one and joined in one set of labels per id; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrase and label; each occurrence counts.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
MAX_TEMPLATES = 200
THRESHOLD = 0.8
#: Label and sentence; the public texts of well-known licenses.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "You may not use this file except in compliance with the license. You may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This source code form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)


def padded(text: Column) -> Column:
    """The words, each between two spaces of its own, so that phrases never share a character.

    ``lower`` equals lower-casing A-Z for all that is counted: no other character becomes a letter of the phrases.
    """
    inner = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS, "  "))
    return F.when(inner == "", "").otherwise(F.concat(F.lit(" "), inner, F.lit(" ")))


def _count(hay: Column, needle: str) -> Column:
    return ((F.length(hay) - F.length(F.replace(hay, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def phrase_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES) -> DataFrame:
    """Id, ``n_words``, and the number, first and last start of all places where a phrase's words stand in a row."""
    df = docs.select(F.col(id_col), padded(F.col(text_col)).alias("_lt_body"))
    body = F.col("_lt_body")
    spaced = lambda p: " " + "  ".join(p.split()) + " "
    n_words = (_count(body, " ") / 2).cast("long")
    df = df.select(id_col, "_lt_body", n_words.alias("n_words"), *[_count(body, spaced(p)).alias(f"_lt_n{i}") for i, (p, _) in enumerate(phrases)])
    first, last = [], []
    for i, (p, _) in enumerate(phrases):
        before, after = F.substring_index(body, spaced(p), 1), F.substring_index(body, spaced(p), -1)
        first.append(F.when(F.col(f"_lt_n{i}") > 0, (_count(before, " ") / 2).cast("long")))
        last.append(F.when(F.col(f"_lt_n{i}") > 0, F.col("n_words") - (_count(after, " ") / 2).cast("long") - len(p.split())))
    return df.select(
        id_col,
        "n_words",
        sum((F.col(f"_lt_n{i}") for i in range(len(phrases))), F.lit(0).cast("long")).alias("n_base"),
        F.least(*first).alias("first_word"),
        F.greatest(*last).alias("last_word"),
        F.array_compact(F.array(*[F.when(F.col(f"_lt_n{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(phrases)])).alias("_lt_base"),
    )


def template_sets(templates=TEMPLATES) -> list[tuple[int, str, list[str], int]]:
    """Number, label, distinct words and number of words of every template."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates")
    words = [[w for w in re.split(SEPARATORS, text.lower()) if w] for _, text in templates]
    return [(i, label, sorted(set(w)), len(w)) for i, ((label, _), w) in enumerate(zip(templates, words, strict=True))]


def needed(template: tuple[int, str, list[str], int], threshold: float) -> tuple[int, int]:
    """Distinct words that a passage must hold, and its length."""
    return max(1, math.ceil(threshold * len(template[2]) - 1e-9)), math.ceil(template[3] / threshold - 1e-9)


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_lt_id``, the paragraph's number and its lower-cased text."""
    split = F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"\n[\x20\x09\x0B-\x0D]*\n", -1)
    return docs.select(F.col(id_col).alias("_lt_id"), F.posexplode(split).alias("_lt_at", "_lt_par"))


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in values]).cast("array<string>")


def best_passage(df: DataFrame, words: Column, name: str) -> DataFrame:
    """``df`` (with t_words and length) with the most distinct words of t_words in ``length`` words in a row as ``name``.

    Only passages that begin with a wanted word need a look. Wanted words and their places are a column of their own,
    so that they are looked up once a row.
    """
    hits = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("at"), w.alias("w"))), lambda h: F.array_contains("t_words", h["w"]))
    near = lambda h, i: F.filter(F.slice("_lt_hits", i + 1, F.col("length")), lambda g: g["at"] < h["at"] + F.col("length"))
    held = F.transform("_lt_hits", lambda h, i: F.size(F.array_distinct(F.transform(near(h, i), lambda g: g["w"]))))
    return df.withColumn("_lt_hits", hits).withColumn(name, F.coalesce(F.array_max(held), F.lit(0)))


def similar_blocks(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, template's label and the containment of its best passage, for every paragraph and template that meet the threshold."""
    spark = docs.sparkSession
    sets = template_sets(templates)
    need = {t[0]: needed(t, threshold)[0] for t in sets}
    vocabulary = sorted({w for _, _, t, _ in sets for w in t})
    split = F.split("_lt_par", SEPARATORS, -1)
    blocks = paragraphs(docs, id_col, text_col).select("_lt_id", "_lt_at", F.array_intersect(split, strings(vocabulary)).alias("tokens"))
    blocks = materialise(blocks.filter(F.size("tokens") > 0), "license-blocks")
    counted = blocks.select(F.explode("tokens").alias("w")).groupBy("w").count().collect()  # a row per word of the templates
    frequency = {r["w"]: r["count"] for r in counted}
    order = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}

    prefixes = [
        (i, len(t), need[i], p, order_of, [order[w] for w in t])
        for i, _, t, _ in sets
        for p, order_of in enumerate(sorted(order[w] for w in t)[: len(t) - need[i] + 1])
    ]
    index = spark.createDataFrame(prefixes, "template int, t_size int, need int, t_pos int, w int, t_words array<int>")
    rank = F.create_map(*[F.lit(x) for w, k in order.items() for x in (w, k)])
    least_need = min(need.values())
    ranked = blocks.filter(F.size("tokens") >= least_need).select(
        "_lt_id", "_lt_at", F.sort_array(F.transform("tokens", lambda w: F.element_at(rank, w))).alias("b_words")
    )
    # The least overlap asked for by any template bounds the block's prefix.
    starts = ranked.select("*", F.posexplode(F.slice("b_words", F.lit(1), F.size("b_words") - least_need + 1)).alias("b_pos", "w"))
    pairs = starts.join(F.broadcast(index), "w").filter(
        (F.size("b_words") >= F.col("need"))  # length
        & (F.col("b_pos") <= F.size("b_words") - F.col("need"))  # the block's prefix for this template
        & (F.least(F.col("t_size") - F.col("t_pos"), F.size("b_words") - F.col("b_pos")) >= F.col("need"))  # position
    )
    overlap = F.size(F.array_intersect("b_words", "t_words"))
    pairs = materialise(pairs.filter(overlap >= F.col("need")).select("_lt_id", "_lt_at", "template").distinct(), "license-pairs")
    discard(blocks)

    wanted = spark.createDataFrame([(t[0], t[1], t[2], *needed(t, threshold)) for t in sets], "template int, label string, t_words array<string>, need int, length int")
    by_rank = {k: w for w, k in order.items()}
    held = strings(sorted({by_rank[p[4]] for p in prefixes}))
    texts = paragraphs(docs, id_col, text_col).filter(F.arrays_overlap(split, held))
    same = pairs["_lt_id"].eqNullSafe(texts["_lt_id"]) & (pairs["_lt_at"] == texts["_lt_at"])
    near = texts.join(pairs, same).join(F.broadcast(wanted), "template")
    near = best_passage(near.select(texts["_lt_id"].alias(id_col), texts["_lt_at"].alias("_lt_at"), "_lt_par", "template", "label", "need", "t_words", "length"), F.array_remove(split, ""), "o")
    # The grouping keeps the filter above the passages: pushed below, it would look them up once a word.
    near = near.groupBy(id_col, "_lt_at", "template", "label", "need", F.size("t_words").alias("t_size")).agg(F.max("o").alias("o"))
    return near.filter(F.col("o") >= F.col("need")).select(id_col, "label", (F.col("o") / F.col("t_size")).alias("containment")).distinct()


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: counts and places of the phrases, ``base_labels``, ``labels`` and ``score``."""
    base = phrase_places(docs, id_col, text_col)
    found = (
        similar_blocks(docs, templates, threshold, id_col, text_col)
        .groupBy(F.col(id_col).alias("_lt_id"))
        .agg(F.collect_set("label").alias("_lt_labels"), F.max("containment").alias("_lt_score"))
    )
    out = base.join(found, F.col(id_col).eqNullSafe(F.col("_lt_id")), "left")
    join = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return out.select(
        id_col,
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        join(F.col("_lt_base")).alias("base_labels"),
        join(F.concat("_lt_base", F.coalesce("_lt_labels", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("_lt_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_lt_score", F.lit(0.0))).alias("score"),
    )
