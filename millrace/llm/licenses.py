"""Licence scans: a paragraph classifier over sparse word n-grams, in DataFrame operations only.

A multinomial logistic regression over word unigrams and bigrams is trained on the driver from paragraphs made of the
known notices below (with words dropped, swapped and added) and of ordinary ones. Its temperature is fitted on held-out
paragraphs, and its unknown class takes every paragraph whose best family stays under the calibrated probability. A
prediction is confirmed by comparing the paragraph with its family's notices: the share of a notice's bigrams that it has.

Scoring: a paragraph is a line of the text, or some adjacent lines joined (``WINDOWS``), as notices are wrapped in source
files; joined lines begin at one that has a word of the notices (other than ``STOPS``). Joined lines count only where
they are confirmed; of paragraphs that overlap a single line stays, then the one that has most of a notice. Only
paragraphs with two or more different words of the notices can be predicted at all; their n-grams meet the weights, a
table of bounded size, in a broadcast join and are summed. Each line is cut into words once.

Rows: null and empty texts have no paragraphs. Every row is reported on its own, whatever its doc_id (null or repeated);
an empty table gives an empty one; other columns are ignored. A text's words are held together in one task.
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch

#: Confirmed from this share of a notice's bigrams.
COVER = 0.6
#: Lines of a paragraph.
WINDOWS = (1, 2, 3, 4, 6, 8)
#: Made paragraphs by family, and ordinary ones.
SAMPLES, ORDINARY = 160, 3000
#: Share of held-out ordinary paragraphs that may pass the calibrated probability.
FALSE_RATE = 0.001

# Notices by licence family.
NOTICES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "agpl-3.0": ["Licensed under the GNU Affero General Public License, version 3."],
    "bsd": [
        "Released under the BSD License.",
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work under the CC0 1.0 Public Domain Dedication."],
    "isc": ["Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "unlicense": ["Released under the Unlicense.", "This is free and unencumbered software released into the public domain."],
    "proprietary": ["All rights reserved. Unauthorized copying of this file is strictly prohibited.", "Proprietary and confidential. Copyright reserved by the owner."],
}
_ORDINARY = (
    "the a of and to in is was for on with as by at from that this it be are or not have had which their they were an but "
    "river house garden season company market people history water mountain music teacher report picture evening project data "
    "school winter result science journey letter question answer morning train station village driver license plate permission "
    "public general free software work version source code file apache helicopter students commons creative foundation use copy "
    "terms rights international released under program library person fee author law domain owner hereby granted purpose wrote "
    "said went under tree new old city small large long first last other many more time year day man woman child world life"
).split()
STOPS = set("the a an of and to in is are by at with or for this that it be you may not any all as on".split())


def tokens(text: str) -> list[str]:
    return re.findall(r"[a-z0-9.]*[a-z0-9]", text.lower())


def token_column(text: Column | str) -> Column:
    """The words of ``tokens``, as a column."""
    return F.regexp_extract_all(F.lower(F.col(text) if isinstance(text, str) else text), F.lit("[a-z0-9.]*[a-z0-9]"), 0)


def grams(words: list[str]) -> list[str]:
    return list(dict.fromkeys([*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]))


def training_paragraphs(seed: int = 3) -> tuple[list[list[str]], list[int]]:
    """Words of made paragraphs and their class: 0 ordinary, then the families in order."""
    rng = random.Random(seed)
    some = lambda n: [rng.choice(_ORDINARY) if rng.random() < 0.8 else "".join(rng.choices("aehilnorst", k=rng.randint(2, 9))) for _ in range(n)]
    out, classes = [], []
    for k, notices in enumerate(NOTICES.values(), 1):
        for i in range(SAMPLES):
            words = [w for w in tokens(notices[i % len(notices)]) if rng.random() > 0.06 or len(notices[i % len(notices)]) < 60]
            out.append(some(rng.choice([0, 0, 3, 12])) + words + some(rng.choice([0, 0, 3, 12])))
            classes.append(k)
    for _ in range(ORDINARY):
        out.append(some(rng.randint(3, 60)))
        classes.append(0)
    return out, classes


class Classifier:
    """Weights by n-gram and class, biases, temperature and the least probability of a family."""

    def __init__(self, seed: int = 3, rounds: int = 200) -> None:
        texts, classes = training_paragraphs(seed)
        order = np.random.default_rng(seed).permutation(len(texts))
        cut = len(order) * 4 // 5
        counts: dict[str, int] = {}
        for i in order[:cut]:
            for g in grams(texts[i]):
                counts[g] = counts.get(g, 0) + 1
        known = {g for notices in NOTICES.values() for n in notices for g in grams(tokens(n))}
        self.vocabulary = sorted(known | {g for g, n in counts.items() if n >= 20 and " " not in g})
        at = {g: i for i, g in enumerate(self.vocabulary)}
        x = np.zeros((len(texts), len(at)), np.float32)
        for row, words in enumerate(texts):
            own = [at[g] for g in grams(words) if g in at]
            x[row, own] = 1
        y = np.array(classes)
        target = np.eye(len(NOTICES) + 1, dtype=np.float32)[y]
        fit, rest = order[:cut], order[cut:]
        w, b = np.zeros((len(at), len(NOTICES) + 1), np.float32), np.zeros(len(NOTICES) + 1, np.float32)
        for _ in range(rounds):
            g = self._softmax(x[fit] @ w + b) - target[fit]
            w -= 3.0 * (x[fit].T @ g / len(fit) + 1e-5 * w)
            b -= 3.0 * g.mean(axis=0)
        self.weights, self.bias = w.astype(np.float64), b.astype(np.float64)
        scores = x[rest] @ w + b
        losses = {t: -np.log(self._softmax(scores / t)[np.arange(len(rest)), y[rest]] + 1e-12).mean() for t in (0.5, 0.7, 1.0, 1.4, 2.0)}
        self.temperature = min(losses, key=losses.get)
        best = self._softmax(scores / self.temperature)[:, 1:].max(axis=1)
        self.least = float(max(0.5, np.quantile(best[y[rest] == 0], 1 - FALSE_RATE)))
        self.held_out_accuracy = float((scores.argmax(axis=1) == y[rest]).mean())
        self.words = sorted({w for notices in NOTICES.values() for n in notices for w in tokens(n)} - STOPS)

    @staticmethod
    def _softmax(s: np.ndarray) -> np.ndarray:
        e = np.exp(s - s.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


_model: list[Classifier] = []


def default_model() -> Classifier:
    if not _model:
        _model.append(Classifier())
    return _model[0]


def license_paragraphs(docs: DataFrame, model: Classifier | None = None, cover: float = COVER) -> DataFrame:
    """Paragraphs with a known family: row (of the input), doc_id, paragraph (its first line), lines, family, probability, cover, confirmed;
    those under the calibrated probability have the family ``unknown``."""
    return _scanned(docs, model, cover)[1]


def _scanned(docs: DataFrame, model: Classifier | None, cover: float = COVER) -> tuple[DataFrame, DataFrame]:
    """All rows (row, doc_id), and ``license_paragraphs``."""
    spark = docs.sparkSession
    model = model or default_model()
    scratch = Scratch(spark, "licences")
    known = F.array(*[F.lit(w) for w in model.words])
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.transform(F.split("text", "\n"), token_column).alias("parts"))
    rows = rows.withColumn("hits", F.transform("parts", lambda words: F.size(F.array_intersect(words, known))))
    none = "paragraph:int,lines:int,words:array<string>"

    def windows(n: int) -> Column:
        """Paragraphs of n lines; of several lines those that begin at a hit and have two."""
        inside = lambda i: i + n <= F.size("hits")
        hits = lambda i: F.aggregate(F.slice("hits", i + 1, F.lit(n)), F.lit(0), lambda s, x: s + x)
        begin = F.filter(F.sequence(F.lit(0), F.size("hits") - 1), lambda i: inside(i) & (F.get("hits", i) >= 1) & (hits(i) >= 2))
        return F.transform(begin, lambda i: F.struct(i.alias("paragraph"), F.lit(n).alias("lines"), F.flatten(F.slice("parts", i + 1, F.lit(n))).alias("words")))

    # every row has a first entry without words, so that rows and paragraphs are numbered in one pass
    mark = F.array(F.struct(F.lit(-1).alias("paragraph"), F.lit(0).alias("lines"), F.array().cast("array<string>").alias("words")))
    cuts = F.when(F.col("parts").isNull(), F.array().cast(f"array<struct<{none}>>")).otherwise(F.concat(*[windows(n) for n in WINDOWS]))
    every = rows.select("row", "doc_id", F.explode(F.concat(mark, cuts)).alias("w")).select("row", "doc_id", "w.*")
    # stored with a key of their own: later joins need no more than it
    every = scratch.cut(every.filter((F.col("lines") == 0) | (F.size(F.array_intersect("words", known)) >= 2)).select(F.concat_ws(":", "row", "paragraph", "lines").alias("key"), "row", "doc_id", "paragraph", "lines", "words"))
    likely = every.filter("lines > 0")
    pairs = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.concat_ws(" ", F.element_at("words", i), F.element_at("words", i + 1)))
    likely = likely.withColumn("bigrams", F.when(F.size("words") > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>")))
    # joined lines count only if confirmed, so those that can't be needn't be scored
    noticed = [[g for g in grams(tokens(n)) if " " in g] for own in NOTICES.values() for n in own]
    fewest = min(int(np.ceil(cover * len(own))) for own in noticed)
    within = F.array(*[F.lit(g) for g in sorted({g for own in noticed for g in own})])
    likely = scratch.cut(likely.filter((F.col("lines") == 1) | (F.size(F.array_intersect("bigrams", within)) >= fewest)))
    names = ["none", *NOTICES]
    table = spark.createDataFrame([(g, *w) for g, w in zip(model.vocabulary, model.weights.tolist(), strict=True)], "gram string, " + ", ".join(f"w{k} double" for k in range(len(names))))
    met = likely.select("key", F.explode(F.array_distinct(F.concat("words", "bigrams"))).alias("gram")).join(F.broadcast(table), "gram")
    # sums in a fixed order of decimals, so that no partitioning changes a digit
    sums = met.groupBy("key").agg(*[F.sum(F.col(f"w{k}").cast("decimal(18,9)")).cast("double").alias(f"s{k}") for k in range(len(names))])
    logits = [(F.col(f"s{k}") + float(model.bias[k])) / model.temperature for k in range(len(names))]
    top = F.greatest(*logits)
    total = sum((F.exp(v - top) for v in logits[1:]), F.exp(logits[0] - top))
    best = F.greatest(*[F.struct((F.exp(v - top) / total).alias("p"), F.lit(name).alias("family")) for v, name in zip(logits[1:], names[1:], strict=True)])
    scored = sums.select("key", best.alias("best")).select("key", F.col("best.p").alias("probability"), F.when(F.col("best.p") >= model.least, F.col("best.family")).otherwise("unknown").alias("family"))
    notices = spark.createDataFrame([(f, [g for g in grams(tokens(n)) if " " in g]) for f, own in NOTICES.items() for n in own], "family string, notice array<string>")
    found = likely.select("key", "row", "doc_id", "paragraph", "lines", "bigrams").join(scored, "key")
    share = F.size(F.array_intersect("bigrams", "notice")) / F.size("notice")
    compared = found.join(F.broadcast(notices), "family", "left").groupBy("key", "row", "doc_id", "paragraph", "lines", "family", "probability").agg(F.coalesce(F.max(share), F.lit(0.0)).alias("cover"))
    compared = scratch.cut(compared.select("row", "doc_id", "paragraph", "lines", "family", "probability", "cover", (F.col("cover") >= cover).alias("confirmed")))
    place = F.struct((F.col("lines") > 1).alias("joined"), (-F.col("cover")).alias("less"), "lines", "paragraph")
    meet = lambda x, y: (x["paragraph"] < y["paragraph"] + y["lines"]) & (y["paragraph"] < x["paragraph"] + x["lines"])
    sure = compared.filter("confirmed").groupBy("row").agg(F.array_sort(F.collect_list(place)).alias("all"))
    none = F.array().cast("array<struct<joined:boolean,less:double,lines:int,paragraph:int>>")
    chosen = sure.select("row", F.aggregate("all", none, lambda got, x: F.when(F.exists(got, lambda y: meet(x, y)), got).otherwise(F.concat(got, F.array(x)))).alias("chosen"))
    met = compared.join(chosen, "row", "left").withColumn("chosen", F.coalesce("chosen", none))
    here = F.struct("paragraph", "lines")
    own = F.exists("chosen", lambda y: (y["paragraph"] == F.col("paragraph")) & (y["lines"] == F.col("lines")))
    stays = F.when(F.col("confirmed"), own).otherwise((F.col("lines") == 1) & ~F.exists("chosen", lambda y: meet(here, y)))
    found = met.filter(stays).select("row", "doc_id", "paragraph", "lines", "family", "probability", "cover", "confirmed")
    return every.filter("lines = 0").select("row", "doc_id"), found


def license_report(docs: DataFrame, model: Classifier | None = None) -> DataFrame:
    """By row: doc_id, n_licenses (confirmed paragraphs), families (sorted, comma-joined), findings (paragraph:family,
    in order) and n_unknown (likely paragraphs that stay without a confirmed family)."""
    rows, found = _scanned(docs, model)
    sure = F.col("confirmed")
    by_row = found.groupBy("row").agg(
        F.array_sort(F.collect_set(F.when(sure, F.struct("paragraph", "family")))).alias("sure"),
        F.size(F.collect_set(F.when(~sure, F.col("paragraph")))).cast("long").alias("n_unknown"),
    )
    met = rows.join(by_row, "row", "left")
    listed = lambda value: F.coalesce(F.array_join(value, ","), F.lit(""))
    return met.select(
        "doc_id",
        F.coalesce(F.size("sure"), F.lit(0)).cast("long").alias("n_licenses"),
        listed(F.array_sort(F.array_distinct(F.col("sure.family")))).alias("families"),
        listed(F.transform("sure", lambda x: F.concat_ws(":", x["paragraph"], x["family"]))).alias("findings"),
        F.coalesce("n_unknown", F.lit(0)).cast("long").alias("n_unknown"),
    )
