"""License scans: fixed phrases, and an exact set-similarity join of text blocks with license templates.

Only DataFrame functions are used. A block is any run of a text's words, over line ends too, as long as the template
would be if a CONTAINMENT of it were the template. A block matches if it contains at least that share of the template's
distinct words, among them all those by which it differs from other licenses.

Words stand in one global order, rarest first, by the texts that have them. A match shares at least a = ceil(CONTAINMENT
* |T|) words, so that one of the template's first |T| - a + 1 words is in the block, or the rarest that must be (prefix
filter). Only stretches of text around such words are looked at: a place of W words, the longest block, that has one,
with W words on either side, holds all blocks with that word. A stretch needs as many words as any match (length filter),
and enough of the template's words from its first and to its last one (positional filter). What remains is compared block
by block on whole sets.
"""

from __future__ import annotations

import math
import re
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Staged, documents

CONTAINMENT = 0.8
#: Phrases that give a label wherever their words stand together.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Short notices as they are commonly written, each with the words that a block must have.
TEMPLATES = [
    ("mit", "Released under the MIT License", "mit"),
    ("mit", "Licensed under the MIT License", "mit"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "free charge"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache 2"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at", "compliance"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", "gnu general public"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gnu general public"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "gnu lesser"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "gnu affero"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution binary"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "without fee"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", "cc nc"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", "cc sa"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0", "cc nd"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "commons noncommercial"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "commons sharealike"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", "commons attribution"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "waived"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "unencumbered"),
]
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    low = text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def _lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _times(text: Column, part: str) -> Column:
    """How often part occurs; occurrences can't overlap here."""
    less = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(part)))
    return F.when(F.contains(text, F.lit(part)), (less / len(part.encode())).cast("long")).otherwise(F.lit(0).cast("long"))


def _literals(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)) if words else F.expr("cast(array() as array<string>)")


class Template:
    """A label, the distinct words in the global order, how many of them a match has, those that it must have, the words
    of a block, and the words one of which every match has."""

    def __init__(self, label: str, text: str, must: str, containment: float, order: dict[str, int]):
        words = words_of(text)
        self.label, self.words = label, sorted(set(words), key=lambda w: (order.get(w, 0), w))
        self.need, self.must = math.ceil(containment * len(self.words) - 1e-9), sorted(set(words_of(must)))
        self.block = math.ceil(len(words) / containment - 1e-9)
        first = [w for w in self.words if w in self.must][:1]
        self.prefix = first or self.words[: len(self.words) - self.need + 1]


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(_lower(F.coalesce(text, F.lit(""))), _GAP, " ")), " ")


def _order(read: DataFrame, templates: list[tuple[str, str, str]]) -> dict[str, int]:
    """How many texts have each of the templates' words."""
    vocabulary = sorted({w for _, text, _ in templates for w in words_of(text)})
    found = read.select(F.explode(F.array_intersect(_literals(vocabulary), _words(F.col("text")))).alias("word"))
    return {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}  # templates' words only


def _scan(read: DataFrame, templates: list[Template], phrases: dict[str, str]) -> DataFrame:
    """Base figures of each row, and its stretches around words with which matches begin."""
    first, wide, least = sorted({w for t in templates for w in t.prefix}), max(t.block for t in templates), min(t.need for t in templates)
    lower = read.select("id", F.monotonically_increasing_id().alias("row"), _lower(F.coalesce("text", F.lit(""))).alias("low"))
    split = lower.select("id", "row", F.trim(F.regexp_replace("low", _GAP, " ")).alias("flat")).withColumn("words", F.split("flat", " "))
    places = F.array_distinct(F.filter(F.transform("words", lambda w, i: F.when(w.isin(first), F.floor(i / wide).cast("int"))), lambda x: x.isNotNull()))
    # around each place, once however many such words it has: no more than three times the text
    stretch = lambda k: F.slice("words", F.greatest(F.lit(1), (k - 1) * wide + 1), F.when(k > 0, 3 * wide).otherwise(2 * wide))
    split = split.withColumn("blocks", F.filter(F.transform(places, stretch), lambda b: F.size(b) >= least))
    spaces = F.octet_length("flat") - F.octet_length(F.replace("flat", F.lit(" ")))
    # each word in its own pair of spaces, so that occurrences of phrases side by side don't share one
    wide = F.when(F.col("flat") == "", "").otherwise(F.concat(F.lit(" "), F.replace("flat", F.lit(" "), F.lit("  ")), F.lit(" ")))
    may = [F.contains(F.concat(F.lit(" "), F.col("flat"), F.lit(" ")), F.lit(f" {p} ")) for p in phrases]
    any_phrase = may[0]
    for m in may[1:]:
        any_phrase = any_phrase | m
    counted = split.select("id", "row", "blocks", F.when(F.col("flat") == "", 0).otherwise(spaces + 1).cast("long").alias("n_words"), F.when(any_phrase, wide).otherwise("").alias("wide"))
    before = lambda prefix: ((F.octet_length(prefix) - F.octet_length(F.replace(prefix, F.lit(" ")))) / 2).cast("long")
    total, first, last, labels = F.lit(0).cast("long"), [], [], []
    for phrase, label in phrases.items():
        part = "".join(f" {w} " for w in phrase.split())
        n = _times(F.col("wide"), part)
        total = total + n
        first.append(F.when(n > 0, before(F.substring_index("wide", part, 1))))
        last.append(F.when(n > 0, F.col("n_words") - before(F.substring_index("wide", part, -1)) - len(phrase.split())))
        labels.append(F.when(n > 0, F.lit(label)))
    pad = F.lit(None).cast("long")
    return counted.select("id", "row", "n_words", total.alias("n_base"), F.least(*first, pad).alias("first_word"), F.greatest(*last, pad).alias("last_word"), F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("base"), "blocks")


def _matches(blocks: DataFrame, templates: list[Template]) -> DataFrame:
    """row, label, containment of each stretch and template with a matching block."""
    rows = [(w, t.label, len(t.words), t.need, t.block, t.words, t.must) for t in templates for w in t.prefix]
    # as many rows as the templates' prefixes have words, whatever the corpus
    index = F.broadcast(blocks.sparkSession.createDataFrame(rows, "word string, label string, size int, need int, block int, template array<string>, must array<string>"))
    first = sorted({r[0] for r in rows})
    near = blocks.select("row", "words", F.explode(F.array_intersect(_literals(first), F.col("words"))).alias("word")).join(index, "word")
    common = F.filter("words", lambda w: F.array_contains("template", w))
    near = near.where((F.size(F.array_intersect("template", "words")) >= F.col("need")) & (F.size(common) >= F.col("need"))).drop("word").distinct()
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - F.col("block") + 1))
    block = lambda i: F.slice("words", i, F.col("block"))
    shared = F.transform(starts, lambda i: F.when(F.size(F.array_intersect(block(i), "must")) == F.size("must"), F.size(F.array_intersect(block(i), "template"))).otherwise(0))
    found = near.withColumn("shared", F.array_max(shared)).where(F.col("shared") >= F.col("need"))
    return found.select("row", "label", (F.col("shared") / F.col("size")).alias("contained"))


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str, str]] | None = None, phrases: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """One row per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Templates are (label, text, words that a block must have). score is the largest containment of a template in a
    block, 1 where a phrase occurs, else 0. A null text counts as empty; null ids and repeated rows are kept; a template
    that matches several blocks counts once; very long texts are read whole, and a row's stretches are never longer than
    three times its text; other columns aren't read; an empty table gives no rows.
    """
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    read = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    order = _order(read, templates)
    compiled = [Template(*t, containment, order) for t in templates]
    stage = Staged(df.sparkSession, "licenses")
    scanned = stage.write(_scan(read, compiled, phrases), "scanned")
    blocks = scanned.select("row", F.explode("blocks").alias("words"))
    found = _matches(blocks, compiled).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("contained").alias("contained"))
    out = scanned.drop("blocks").join(found, "row", "left")
    both = F.array_sort(F.array_union("base", F.coalesce("more", F.expr("cast(array() as array<string>)"))))
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("contained", F.lit(0.0))).alias("score"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of all documents."""
    return license_scan(documents(spark, sf_dir))
