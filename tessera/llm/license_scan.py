"""Licence scan with a positional rare-token index, in DataFrame functions only.

Every template (a phrase or a notice) is indexed under its rarest word: the one of the highest inverse document
frequency, counted over all documents of the scan. A file's words are looked up in that index; a posting gives the
place where the template would start, by the word's position relative to it. There the template's mandatory key phrase
is verified word by word, and the score is the share of the template's IDF whose words stand at their relative
positions. As a template's rarest word is part of its mandatory phrase, every place of the phrase is found.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z. Null and empty texts have no words, counts of 0,
null positions and empty labels. Repeated rows are each scanned and counted. Ties of IDF go to the word that sorts
first. Very long texts are scanned whole. Other columns are ignored, whatever their names; an empty table gives none. The
index is one constant map in the plan, as large as the list of templates (a parameter), whatever the input.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._columns import LETTERS_GAP, let, lower_ascii, pieces, shown

# The base phrases of the contract and their labels.
BASE = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
# Paragraphs of well-known licences and notices, with their mandatory key phrases between bars, and their labels.
NOTICES = (
    ("mit", "|permission is hereby granted free of charge| to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", "the above copyright notice and this permission notice |shall be included in all copies or substantial portions of the software|"),
    ("apache", "you |may not use this file except in compliance with the license| you may obtain a copy of the license at"),
    ("apache", "|subject to the terms and conditions of this license each contributor hereby grants to you| a perpetual worldwide non exclusive no charge royalty free irrevocable"),
    ("gpl", "this program is free software you can |redistribute it and or modify it under the terms of| the gnu general public license as published by the free software foundation"),
    ("gpl", "everyone is permitted to copy and distribute |verbatim copies of this license document but changing it is not allowed|"),
    ("lgpl", "|gnu lesser general public license|"),
    ("agpl", "|gnu affero general public license|"),
    ("bsd", "|redistribution and use in source and binary forms with or without modification| are permitted provided that the following conditions are met"),
    ("bsd", "|redistributions of source code must retain the above copyright notice| this list of conditions and the following disclaimer"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors |may be used to endorse or promote products derived from this software| without specific prior written permission"),
    ("mpl", "this source code form is subject to the terms of the |mozilla public license|"),
    ("isc", "|permission to use copy modify and or distribute this software for any purpose| with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "|permission is granted to anyone to use this software for any purpose| including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("bsl", "|permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation|"),
    ("cc-by", "|creative commons attribution| 4 0 international"),
    ("cc0", "|the person who associated a work with this deed has dedicated the work to the public domain|"),
    ("epl", "the accompanying program is provided under the terms of this |eclipse public license|"),
    ("unlicense", "this is |free and unencumbered software released into the public domain|"),
    ("unlicense", "|anyone is free to copy modify publish use compile sell or distribute this software| either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("wtfpl", "|do what the fuck you want to public license|"),
)


class Template:
    def __init__(self, label: str, text: str, base: bool):
        before, phrase, after = text.split("|") if "|" in text else ("", text, "")
        self.label, self.base = label, base
        self.words = before.split() + phrase.split() + after.split()
        self.lo = len(before.split())
        self.hi = self.lo + len(phrase.split())


    def weights(self, idf: dict[str, float]) -> list[float]:
        """The share of each word in the template's IDF."""
        total = sum(idf[w] for w in self.words) or 1.0
        return [idf[w] / total for w in self.words]


TEMPLATES = tuple([Template(k, t, True) for k, t in BASE] + [Template(k, t, False) for k, t in NOTICES])


def file_words(text: Column) -> Column:
    return pieces(lower_ascii(F.coalesce(text, F.lit(""))), LETTERS_GAP)


def inverse_frequencies(docs: DataFrame, templates: tuple[Template, ...]) -> dict[str, float]:
    """ln((1 + documents) / (1 + documents with the word)) of every template word, over all documents."""
    vocabulary = sorted({w for t in templates for w in t.words})
    words = docs.select(F.explode(F.array_append(F.array_distinct(F.filter(file_words(F.col("text")), lambda w: w.isin(vocabulary))), F.lit(""))).alias("word"))
    found = {r["word"]: r["n"] for r in words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: log((1 + found.get("", 0)) / (1 + found.get(w, 0))) for w in vocabulary}


def index_of(templates: tuple[Template, ...], idf: dict[str, float]) -> tuple[list[str], Column]:
    """The rarest words of the templates, and a map from each to its postings: the templates with the place of the word in them."""
    postings: dict[str, list[Column]] = {}
    for t in templates:
        rare = min(t.words[t.lo : t.hi], key=lambda w: (-idf[w], w))
        postings.setdefault(rare, []).append(
            F.struct(
                F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.lit(t.lo + t.words[t.lo : t.hi].index(rare)).alias("place"), F.lit(t.lo).alias("lo"), F.lit(t.hi - t.lo == len(t.words)).alias("whole"),
                F.array(*map(F.lit, t.words[t.lo : t.hi])).alias("phrase"), F.array(*map(F.lit, t.words)).alias("words"), F.array(*map(F.lit, t.weights(idf))).alias("weights"),
            )
        )
    return sorted(postings), F.create_map(*(x for w, p in sorted(postings.items()) for x in (F.lit(w), F.array(*p))))


def license_scan(docs: DataFrame, least_score: float = 0.6, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and n_places (of all templates)."""
    rares, index = index_of(templates, inverse_frequencies(docs, templates))
    words = F.col("words")

    def verified(t: Column, at: Column) -> Column:
        """The template's place if it starts where its rarest word, at index at, says; else null."""
        start = at - t["place"]
        found = F.slice(words, F.greatest(start + t["lo"], F.lit(0)) + 1, F.size(t["phrase"])) == t["phrase"]
        shares = F.zip_with(F.sequence(F.lit(0), F.size(t["words"]) - 1), t["words"], lambda j, w: F.when(F.get(words, start + j) == w, F.get(t["weights"], j)).otherwise(F.lit(0.0)))
        score = F.when(t["whole"], F.lit(1.0)).otherwise(F.least(F.aggregate(shares, F.lit(0.0), lambda a, x: a + x), F.lit(1.0)))
        place = lambda s: F.when(s >= least_score, F.struct(t["label"].alias("label"), (start + t["lo"]).alias("at"), t["base"].alias("base"), s.alias("score")))
        return F.when((start + t["lo"] >= 0) & found, let(score, place))

    looked_up = lambda i: F.transform(index[F.get(words, i)], lambda t: verified(t, i))
    rare = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(rares))
    places = F.when(F.exists(words, lambda w: w.isin(rares)), F.filter(F.flatten(F.transform(rare, looked_up)), lambda p: p.isNotNull()))
    docs = docs.select("doc_id", file_words(F.col("text")).alias("words")).select("doc_id", F.size("words").cast("long").alias("n_words"), places.alias("places"))
    labels = lambda p: shown(F.array_sort(F.array_distinct(F.transform(p, lambda x: x["label"]))))
    base = F.filter("places", lambda p: p["base"])
    docs = docs.withColumn("base", F.coalesce(base, F.filter(F.array(F.struct(F.lit("").alias("label"), F.lit(0).alias("at"), F.lit(False).alias("base"), F.lit(0.0).alias("score"))), lambda p: p["base"])))
    return docs.select(
        "doc_id", "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda p: p["at"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda p: p["at"])).cast("long").alias("last_word"),
        labels(F.col("base")).alias("base_labels"),
        F.coalesce(labels(F.col("places")), F.lit("")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)).alias("score"),
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_places"),
    )
