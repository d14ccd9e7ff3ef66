"""License scans with a trained paragraph classifier, in Spark expressions only.

A paragraph is a part between blank lines, or a line where a text has no blank line.  Each is
judged by a logistic regression over sparse word 1- to 3-grams, one weight vector per licence
family.  The regression is fitted on perturbed template paragraphs and on paragraphs that only
mention licences; half of them calibrate the probability below which a paragraph is
``unknown``.  A predicted family is confirmed if enough of one of its templates' 3-grams occur
in the paragraph.

The model tells which paragraphs need scoring: a family can only reach the threshold if its
n-grams outweigh the unknown class by a known amount, so a set of words is chosen for which
all n-grams without one of them together stay below that amount for every family
(``Model.gate``).  A paragraph without any of these words is unknown whatever else it says.

Reported are the paragraphs with a family, and unknown ones that speak of licences (``TOPIC``,
which decides nothing else).

The features and templates are of a fixed number (``features`` bounds them), so they are
literals of the plan.  Each document is worked on in its row: no shuffle, no Python.

Null and empty texts have no paragraphs and give no rows; neither does an empty table.  Null
ids and repeated rows keep theirs; other columns are ignored.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion.llm.boosting import calibrate
from papyrion.llm.rows import quoted

# Words of licences, and the families' names and abbreviations (MIT in capitals: "mit" is a German word).
WORDS = r"licen[cs]|copyright|\bcopyleft|redistribut|warrant|public domain|rights reserved|permission"
NAMES = r"creative[\s-]+commons|\bcc[\s_-]*(?:by|0|zero)(?![a-z])|\b[al]?gpl|\bgnu\b|general public|\bbsd\b|\bisc\b|\bmpl|\bmozilla\b|\bapache\b|\bspdx\b|\bunder\s+(?:the\s+)?mit\b|(?-i:\bMIT\b)|unencumbered|proprietary|confidential"
TOPIC = rf"(?i){WORDS}|{NAMES}"
UNKNOWN = "unknown"

# Short template paragraphs by licence family.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http www apache org licenses LICENSE-2.0"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD 3-Clause License", "Licensed under the BSD license"],
    "CC-BY": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"],
    "CC-BY-NC": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0"],
    "CC-BY-SA": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Licensed under CC BY-SA 4.0"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "Released under the GPL v3 license"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License"],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "Licensed under the LGPL version 2.1"],
    "MIT": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License 2.0"],
    "proprietary": ["All rights reserved", "This document is proprietary and confidential; no part may be reproduced without written permission of the copyright holder"],
    "public-domain": ["This is free and unencumbered software released into the public domain", "This work has been dedicated to the public domain under CC0 1.0 Universal"],
}
# Paragraphs that speak of licences and grant none.
MENTIONS = [
    "he lost his driving licence on the way home", "the licensed plumber came on monday", "you need permission to enter the building", "the warranty of the machine ends in june",
    "the copyright office opened a new branch", "they sell software licenses to schools", "a fishing license is required at the lake", "she asked for permission to speak",
    "the court reviewed the copyright claim", "the restaurant lost its liquor license", "redistribution of income was debated", "no warrant was issued for the search",
    "license plates are made here", "the pilot license exam is hard", "the general public was invited to the version", "an open meeting under the new terms",
    "permission was granted to the public", "a copy of the warrant was obtained", "the creative commons of the village are open for use", "all reserved seats were sold with permission",
    "er kommt mit dem bus und geht mit uns", "the apache people and the gnu in the zoo", "the version of the software for the public",
]

# Words that say nothing about licences; an n-gram of these and of numbers alone is no feature.
PLAIN = set("a all an and any are as at be by can for from if in is it may no not of on or that the this to under use used was which with without work you your".split())


def ngrams(paragraph: Column, longest: int = 3) -> Column:
    """The distinct word 1- to ``longest``-grams of a paragraph, in ASCII letters and digits."""
    words = F.split(F.trim(F.regexp_replace(F.lower(paragraph), "[^a-z0-9]+", " ")), " ")

    def grams(w: Column) -> Column:
        made = [w]
        for n in range(2, longest + 1):
            made.append(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda k: F.array_join(F.slice(w, k, _length(n)), " ")))
        return F.array_distinct(F.flatten(F.array(*made)))

    return F.transform(F.array(words), grams)[0]


def _length(n: int) -> Column:
    return F.lit(n)


def training_paragraphs(n: int = 1500, seed: int = 3, without: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    """(family or unknown, paragraph): templates (but those in ``without``) and mentions among other words, with some words lost."""
    rng = random.Random(seed)
    filler = "lorem data house river table walk green note seven code page under the of and to in is for with this that year".split()
    families = [(f, t) for f, ts in TEMPLATES.items() for t in ts if t not in without]
    rows = []
    for k in range(n):
        family, text = families[k // 2 % len(families)] if k % 2 else (UNKNOWN, rng.choice(MENTIONS))
        words = [w for w in text.split() if rng.random() > 0.04 or len(text.split()) < 8]
        before, after = ([rng.choice(filler) for _ in range(rng.choice([0, 0, 3, 12]))] for _ in range(2))
        rows.append((family, " ".join([*before, *words, *after])))
    return rows


def fit_regression(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 300, rate: float = 2.0, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features, classes) and biases of a multinomial logistic regression, by gradient descent."""
    w, b = np.zeros((x.shape[1], classes)), np.zeros(classes)
    target = np.eye(classes)[y]
    for _ in range(rounds):
        error = softmax(x @ w + b) - target
        w -= rate * (x.T @ error / len(x) + ridge * w)
        b -= rate * error.mean(axis=0)
    return w, b


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Model:
    """Weights of at most ``features`` n-grams, a threshold, and the templates' 3-grams."""

    def __init__(self, spark: SparkSession, features: int = 1500, precision: float = 0.98, n: int = 1500, contained: float = 0.5, without: tuple[str, ...] = ()):
        """``features`` bounds the regression's n-grams (the most frequent ones), not the templates'; ``without`` holds templates out."""
        self.names = [*sorted(TEMPLATES), UNKNOWN]
        self.contained = contained
        data = training_paragraphs(n, without=without)
        joined = "\x1e".join(f"{family}\x1f{text}" for family, text in data)
        rows = spark.range(1).select(F.explode(F.split(F.lit(joined), "\x1e")).alias("s"))
        rows = rows.select(F.substring_index("s", "\x1f", 1).alias("family"), ngrams(F.substring_index("s", "\x1f", -1)).alias("g")).collect()
        shapes = "\x1e".join(f"{family}\x1f{text}" for family in self.names[:-1] for text in TEMPLATES[family] if text not in without)
        shapes = spark.range(1).select(F.explode(F.split(F.lit(shapes), "\x1e")).alias("s"))
        shapes = shapes.select(F.substring_index("s", "\x1f", 1).alias("family"), ngrams(F.substring_index("s", "\x1f", -1)).alias("g")).collect()
        self.shapes = [(r.family, [g for g in r.g if g.count(" ") == 2 or len(r.g) < 6]) for r in shapes]
        said = spark.range(1).select(F.explode(F.split(F.lit("\x1e".join(MENTIONS)), "\x1e")).alias("s")).select(ngrams(F.col("s")).alias("g")).collect()
        known = {g for r in [*shapes, *said] for g in r.g}  # not those with the words around
        counts: dict[str, int] = {}
        for r in rows:
            for g in r.g:
                if g in known and not all(w in PLAIN or w.isdigit() for w in g.split(" ")):
                    counts[g] = counts.get(g, 0) + 1
        self.grams = sorted(counts, key=lambda g: (-counts[g], g))[:features]
        place = {g: k for k, g in enumerate(self.grams)}
        x = np.zeros((len(rows), len(self.grams)))
        for k, r in enumerate(rows):
            for g in r.g:
                if g in place:
                    x[k, place[g]] = 1
        y = np.array([self.names.index(r.family) for r in rows])
        fold = np.arange(len(rows)) // 2 % 2
        self.weights, self.bias = fit_regression(x[fold == 0], y[fold == 0], len(self.names))
        p = softmax(x[fold == 1] @ self.weights + self.bias)
        best = p.argmax(axis=1)
        right = (best == y[fold == 1]) & (best != len(self.names) - 1)
        named = best != len(self.names) - 1
        logit = np.log(p.max(axis=1) / np.maximum(1 - p.max(axis=1), 1e-12))
        self.threshold = float(1 / (1 + np.exp(-calibrate(logit[named], right[named].astype(float), precision))))
        self.held_out = best, p.max(axis=1), y[fold == 1]
        self.gate = self._gate()

    def _gate(self) -> list[str]:
        """Words without which no paragraph can reach the threshold, whatever n-grams it has.

        A family's probability is at least the threshold only if its logit exceeds the unknown
        class's by the threshold's log-odds.  Words are taken, those with most weight first, until
        the n-grams without any of them can't sum to that for any family.
        """
        weights, bias = self.weights.round(6), self.bias
        gain = np.maximum(weights[:, :-1] - weights[:, -1:], 0)
        need = max(0.0, np.log(self.threshold / max(1 - self.threshold, 1e-12))) - (bias[:-1] - bias[-1])
        words = [set(g.split(" ")) for g in self.grams]
        worth: dict[str, float] = {}
        for w, g in zip(words, gain, strict=True):
            for word in w:
                worth[word] = worth.get(word, 0.0) + float(g.max()) / len(w)
        chosen: list[str] = []
        left = np.ones(len(words), bool)
        for word in sorted((w for w in worth if w not in PLAIN and not w.isdigit()), key=lambda w: (-worth[w], w)):
            if (gain[left].sum(axis=0) < need - 1e-6).all():
                return chosen
            chosen.append(word)
            left &= np.array([word not in w for w in words])
        return []  # the bias alone reaches the threshold: every paragraph is scored

    def may_hold(self, paragraph: Column) -> Column:
        """Whether a paragraph (or a whole text) has a word of the gate."""
        return F.lower(paragraph).rlike(r"(?<![a-z0-9])(?:" + "|".join(sorted(self.gate)) + r")(?![a-z0-9])") if self.gate else F.lit(True)

    def score(self, grams: Column) -> Column:
        """Struct of family, probability, similarity (of the family's nearest template) and confirmed."""
        size = len(self.names)
        table = F.map_from_arrays(F.array(*map(F.lit, self.grams)), F.array(*[F.array(*[F.lit(round(float(x), 6)) for x in row]) for row in self.weights]))
        names = F.array(*map(F.lit, self.names))
        matched = F.array_intersect(grams, F.array(*map(F.lit, self.grams)))
        begin = F.array(*[F.lit(float(b)) for b in self.bias])
        logits = F.aggregate(matched, begin, lambda a, g: F.zip_with(a, F.element_at(table, g), lambda p, q: p + q))

        def chosen(z: Column) -> Column:
            top = F.array_max(z)
            total = F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x - top))
            best = F.array_position(z, top).cast("int")
            p = F.lit(1.0) / total
            family = F.when((best == size) | (p < self.threshold), F.lit(UNKNOWN)).otherwise(F.element_at(names, best))
            return F.struct(family.alias("family"), p.alias("probability"))

        found = F.transform(F.array(logits), chosen)[0]

        def compared(x: Column) -> Column:
            likeness = [F.when(x["family"] == family, F.size(F.array_intersect(grams, F.array(*map(F.lit, shape)))) / F.lit(float(len(shape)))).otherwise(F.lit(0.0)) for family, shape in self.shapes]
            near = F.greatest(*likeness)
            return F.struct(x["family"].alias("family"), x["probability"].alias("probability"), near.alias("similarity"), (near >= self.contained).alias("confirmed"))

        return F.transform(F.array(found), compared)[0]


def paragraphs(text: Column, wanted) -> Column:
    """array<struct<paragraph, p>> of the ``wanted`` paragraphs, numbered among all from 0."""
    parts = F.when(text.rlike(r"\n[\x20\t\r]*\n"), F.split(text, r"\n(?:[\x20\t\r]*\n)+", -1)).otherwise(F.split(text, r"\n", -1))
    return F.filter(F.transform(parts, lambda p, k: F.struct(k.alias("paragraph"), p.alias("p"))), lambda x: wanted(x["p"]))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """(id, paragraph, family, probability, similarity, confirmed): a row per paragraph with a family or on the topic."""
    model = model or Model(docs.sparkSession)

    def wanted(p: Column) -> Column:
        return p.rlike(TOPIC) | model.may_hold(p)

    named = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("t")).where(wanted(F.col("t")))
    rows = named.select("id", F.inline(paragraphs(F.col("t"), wanted))).select("id", "paragraph", F.col("p").rlike(TOPIC).alias("topic"), ngrams(F.col("p")).alias("g"))
    scored = rows.select("id", "paragraph", "topic", model.score(F.col("g")).alias("x")).where(F.col("topic") | (F.col("x.family") != UNKNOWN))
    return scored.select(F.col("id").alias(id_col), "paragraph", "x.*")
