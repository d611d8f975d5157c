"""Licence scan by diagonal voting, with DataFrame functions only.

Every window of K words of a text is joined by its hash to the same windows of the licence templates. A match at word
`at` of the text and `place` of the template votes for the diagonal `at - place`, the place where the template would
start. Votes are counted per document, template and diagonal; diagonals at most SHIFT words apart are merged, as a word
put in or left out moves the rest of a notice; a merged span is verified by the share of the template's words it covers.

Templates are a bounded parameter and are broadcast. A window can only match if all its words are template words, so
other windows are left out before the join: a lossless semi-join. What is shuffled are the matches alone, and one short
row for each document. A diagonal holds at most as many votes as its template has words.

Defined results: a null or empty text has no words, places or labels and score 0. Rows are told apart by doc_id and text,
so rows that repeat both get the same result and do not vote twice. Labels that tie are listed once, in order. An empty
table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import let, lowered

K = 3
SHIFT = 2
MIN_COVER = 0.75
MAX_TEMPLATE_WORDS = 200_000
#: Between words: ASCII characters that are no digit and no small letter.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

#: Phrases of the base places, and what each is a place of.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Label and wording of public licence notices.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("reserved", "All rights reserved"),
)


@dataclass(frozen=True)
class TemplateWindow:
    template: int
    label: str
    length: int
    place: int
    words: tuple[str, ...]


def template_windows(templates=TEMPLATES, k: int = K) -> list[TemplateWindow]:
    """The windows of k words of every template; a template needs k words at least."""
    out = []
    for number, (label, wording) in enumerate(templates):
        said = re.sub("[A-Z]", lambda m: m[0].lower(), wording)
        words = [w for w in re.split(BETWEEN, said) if w]
        if len(words) < k:
            raise ValueError(f"template of fewer than {k} words: {wording}")
        out += [TemplateWindow(number, label, len(words), i, tuple(words[i : i + k])) for i in range(len(words) - k + 1)]
    if len(out) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"at most {MAX_TEMPLATE_WORDS} template windows")
    return out


def scan_words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(F.coalesce(text, F.lit(""))), BETWEEN), "")


def _stands(words: Column, at: Column, phrase: list[str]) -> Column:
    """Whether the phrase's words stand at `at`; its last word is looked at first."""
    out = F.lit(True)
    for i in reversed(range(len(phrase))):
        out = out & F.coalesce(F.get(words, at + i) == phrase[i], F.lit(False))
    return out


def _places_of(words: Column, phrase: list[str], label: str) -> Column:
    starts = let(
        words,
        lambda w: F.filter(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0))), lambda i: _stands(w, i, phrase)),
    )
    places = F.transform(starts, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))
    none = F.array().cast("array<struct<at:bigint,label:string>>")
    return F.when(F.array_contains(words, phrase[-1]), places).otherwise(none)


def phrase_places(words: Column, phrases=PHRASES) -> Column:
    """(at, label) of every place where a phrase's words stand, as an array."""
    return F.concat(*[_places_of(words, phrase.split(" "), label) for phrase, label in phrases])


def windows_of(words: Column, known: set[str], k: int = K) -> Column:
    """(at, hash, words) of the windows whose words are all known, as an array."""

    def all_known(w, i):
        out = F.lit(True)
        for j in range(k):
            out = out & F.get(w, i + j).isin(*known)
        return out

    def made(w):
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0))), lambda i: all_known(w, i))
        return F.transform(
            starts,
            lambda i: let(
                F.concat_ws(" ", *[F.get(w, i + j) for j in range(k)]),
                lambda g: F.struct(i.cast("long").alias("at"), F.xxhash64(g).alias("hash"), g.alias("words")),
            ),
        )

    return let(words, made)


def votes(docs: DataFrame, templates=TEMPLATES, k: int = K) -> DataFrame:
    """key, label, template, length, diagonal and the template places that voted for it."""
    windows = template_windows(templates, k)
    spark: SparkSession = docs.sparkSession
    positions = spark.createDataFrame(
        [(w.template, w.label, w.length, w.place, " ".join(w.words)) for w in windows],
        "template int, label string, length int, place int, template_words string",
    ).withColumn("template_hash", F.xxhash64("template_words"))
    known = {word for w in windows for word in w.words}
    grams = docs.select("key", F.explode(windows_of(F.col("words"), known, k)).alias("w")).select("key", "w.*")
    same = (F.col("hash") == F.col("template_hash")) & (F.col("words") == F.col("template_words"))
    matched = grams.join(F.broadcast(positions), same).withColumn("diagonal", F.col("at") - F.col("place"))
    return matched.groupBy("key", "template", "label", "length", "diagonal").agg(F.collect_set("place").alias("places"))


def spans(diagonals: DataFrame, k: int = K, shift: int = SHIFT, min_cover: float = MIN_COVER) -> DataFrame:
    """Neighbouring diagonals merged: key, label, start and cover of those that cover enough of their template."""
    along = Window.partitionBy("key", "template").orderBy("diagonal")
    begins = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > shift, F.lit(True))
    numbered = diagonals.withColumn("begins", begins.cast("int")).withColumn("span", F.sum("begins").over(along))
    merged = numbered.groupBy("key", "template", "label", "length", "span").agg(
        F.min("diagonal").alias("start"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("places")
    )
    reached = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + (k - 1)))))
    cover = merged.withColumn("cover", F.size(reached) / F.col("length"))
    return cover.filter(F.col("cover") >= min_cover).select("key", "label", "start", "cover")


def license_scan(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", templates=TEMPLATES, phrases=PHRASES, k: int = K
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row of `docs`."""
    body = F.col(f"`{text}`")
    key = F.struct(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(body).alias("hash"), F.length(body).alias("length"))
    rows = docs.select(key.alias("key"), scan_words(body).alias("words"))
    found = (
        spans(votes(rows, templates, k), k)
        .groupBy("key")
        .agg(F.collect_set("label").alias("found"), F.max("cover").alias("cover"))
        .withColumnRenamed("key", "found_key")
    )
    base = rows.select(
        "key", F.size("words").cast("long").alias("n_words"), phrase_places(F.col("words"), phrases).alias("places")
    ).select(
        "key",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.col("places.at")).alias("first_word"),
        F.array_max(F.col("places.at")).alias("last_word"),
        F.array_sort(F.array_distinct(F.col("places.label"))).alias("base_found"),
    )
    none = F.array().cast("array<string>")
    return base.join(found, F.col("key").eqNullSafe(F.col("found_key")), "left").select(
        "key.doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_found", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_found", F.coalesce("found", none))), ",").alias("labels"),
        F.greatest(F.coalesce("cover", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"),
    )
