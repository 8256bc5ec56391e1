"""License scans: a trained paragraph classifier with an unknown class, confirmed by comparison with templates.

Native: SQL functions and Spark's own feature hashing and multinomial logistic regression, row-local and without a
shuffle. A paragraph is a run of lines that hold a letter or digit, so a line of comment marks alone ends it. In each
paragraph windows of consecutive lines are compared with the templates: of windows that overlap, the one that agrees best
counts, then the one with fewer lines, then the first. So a notice wrapped over lines or within a longer paragraph is seen
whole. Features are hashed n-grams of one and two words (letters, digits and inner dots, lower case), each counted once;
the elastic-net penalty keeps the weights sparse. A window belongs to a family when that is the likeliest class, its
probability reaches the calibrated threshold, and its n-grams agree with a template of the family: it holds enough of the
template, and all that names the version. A heading must agree in both directions, so naming a licence within a sentence
is no heading. The n-grams of a whole text, or paragraph, hold those of all its windows, so texts and paragraphs that agree
with no template are left out first, without any loss.

Defined results: NULL and empty texts and texts without a licence give no row; equal rows give equal rows; ties between
classes go to the first, unknown last; ``paragraph`` is the number of the window's first line, from 0. Input columns other
than the id and the text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Short notices of each family, as their authors recommend them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License.",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction.",
        "This software is distributed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or any later "
        "version.",
        "Licensed under the GNU GPL v3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "gpl-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or any later "
        "version.",
        "Licensed under the GNU GPL v2.",
        "SPDX-License-Identifier: GPL-2.0-or-later",
    ),
    "cc-by-nc-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Available under the CC BY-NC 4.0 licence.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "cc-by-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-sa-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met.",
        "This code is released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "proprietary": (
        "Copyright. All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced without written permission.",
    ),
}
# Lines that stand above a licence.
HEADINGS: dict[str, tuple[str, ...]] = {
    "apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0"),
    "mit": ("MIT License", "The MIT License (MIT)"),
    "gpl-3.0": ("GNU General Public License, version 3", "GNU GPL v3"),
    "gpl-2.0": ("GNU General Public License, version 2", "GNU GPL v2"),
    "bsd-3-clause": ("BSD 3-Clause License",),
    "mpl-2.0": ("Mozilla Public License, version 2.0",),
}
FAMILIES = tuple(TEMPLATES)
UNKNOWN = len(FAMILIES)
BUCKETS = 1 << 14
BACKGROUND = 2000  # documents whose paragraphs teach the unknown class, at most
COPIES = 40  # variants of each template sentence
AGREEMENT = 0.6
HEADING = 0.75  # agreement of a heading in either direction
# Words that any prose holds; others are looked for first.
COMMON = set("a an and any by cc for from in is may not of or other source that the this to under use with without work you".split())
WORDS = 100  # a window gets no further line once it has so many words; no template has half as many
# Sentences that share words with licences and are none.
NEAR_MISSES = (
    "You may need a licence to drive a car.", "The licence fee was raised by the public office.",
    "The general version of this work is under review.", "The software was released last year.",
    "Permission to use the file was not granted.", "He was licensed as a doctor.", "The apache tribe.",
    "All rights are equal under the law.", "Version 2.0 of the public file.", "See the terms of use.",
)


@dataclass(frozen=True)
class Model:
    classifier: LogisticRegressionModel
    threshold: float


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: what a lambda holds is otherwise computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9.]+|\.+(?![a-z0-9])"), lambda w: w != "")


def grams(text: Column) -> Column:
    """Single words, and each word with the next one."""
    def both(words: Column) -> Column:
        pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.concat(words, F.filter(pairs, lambda p: p.isNotNull()))

    return _bound(tokens(text), both)


def _featured(rows: DataFrame) -> DataFrame:
    hashing = HashingTF(numFeatures=BUCKETS, binary=True, inputCol="grams", outputCol="features")
    return hashing.transform(rows.withColumn("grams", grams(F.col("text"))))


def _sentences(spark: SparkSession, rows: Sequence[tuple[int, str]], copies: int) -> DataFrame:
    """(label, text, variant): each of the given sentences ``copies`` times."""
    values = F.array(*[F.struct(F.lit(float(n)).alias("label"), F.lit(t).alias("text")) for n, t in rows])
    return spark.range(copies).select(F.inline(values), F.col("id").cast("int").alias("variant"))


def training_rows(docs: DataFrame, text_column: str = "text", background: int = BACKGROUND) -> DataFrame:
    """(label, text): templates with words left out or put behind them, and paragraphs of a bounded sample of documents.

    The sample is the documents with the smallest text hashes. Paragraphs that hold a word of a licence do not teach
    the unknown class, because they may be licences; sentences about licences stand in for them.
    """
    spark = docs.sparkSession
    notices = _sentences(spark, [(n, t) for n, family in enumerate(FAMILIES) for t in TEMPLATES[family]], COPIES)
    words = F.split("text", " ")
    kept = F.filter(words, lambda w, i: (F.col("variant") == 0) | (F.pmod(F.xxhash64(w, i, "variant"), F.lit(12)) != 0))
    tail = F.when(F.col("variant") % 3 == 1, F.concat(F.lit(" w"), F.xxhash64("variant").cast("string"))).otherwise("")
    varied = notices.select("label", F.concat(F.array_join(kept, " "), tail).alias("text"))
    headings = _sentences(spark, [(n, t) for n, family in enumerate(FAMILIES) for t in HEADINGS.get(family, ())], COPIES)
    varied = varied.unionByName(headings.select("label", F.concat("text", tail).alias("text")))
    misses = _sentences(spark, [(UNKNOWN, t) for t in NEAR_MISSES], COPIES).select("label", "text")
    sample = docs.where(F.col(text_column).isNotNull()).select(F.col(text_column).alias("text")).orderBy(
        F.xxhash64(text_column), text_column
    ).limit(background)
    lines = sample.select(F.lit(float(UNKNOWN)).alias("label"), F.explode(F.split("text", "\n")).alias("text"))
    plain = lines.where((F.trim("text") != "") & ~F.lower("text").rlike("licen|copyright|spdx|reserved"))
    return varied.unionByName(misses).unionByName(plain)


def fit(docs: DataFrame, text_column: str = "text", background: int = BACKGROUND) -> Model:
    """Weights from four fifths of the training rows. The threshold is the highest probability of a family among the
    unknown paragraphs of the other fifth, within one half and nine tenths."""
    rows = training_rows(docs, text_column, background).distinct()
    data = _featured(rows).select(
        "label", "features", (F.pmod(F.xxhash64("text"), F.lit(5)) == 0).alias("held")
    ).coalesce(4).cache()  # every step of the fit sends one gradient per partition
    classifier = LogisticRegression(
        family="multinomial", maxIter=30, regParam=1e-4, elasticNetParam=0.2, standardization=False
    ).fit(data.where("not held"))
    best = F.array_max(F.slice(vector_to_array("probability"), 1, UNKNOWN))
    alarm = classifier.transform(data.where("held")).where(F.col("label") == UNKNOWN).agg(F.max(best)).first()[0]
    data.unpersist()
    return Model(classifier, min(max(0.5, alarm or 0.0), 0.9))


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9.]+|\.+(?![a-z0-9])", text.lower()) if w]


def _templates() -> list[tuple[int, bool, list[str], list[str]]]:
    """(class, whether a heading, n-grams, n-grams that must be there) of every template. Those that must be there name a
    version, or tell the GNU General from the Lesser and Affero licences."""
    out = []
    for heading, texts in ((False, TEMPLATES), (True, HEADINGS)):
        for n, family in enumerate(FAMILIES):
            for text in texts.get(family, ()):
                words = _words(text)
                pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
                must = [p for p in pairs if re.search(r"\d", p.split()[1]) or p == "gnu general"]
                out.append((n, heading, list(dict.fromkeys(words + pairs)), must))
    return out


def _strings(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _constants() -> Column:
    return F.array(*[F.struct(F.lit(n).alias("class"), F.lit(h).alias("heading"), _strings(g).alias("grams"), _strings(m).alias("must"))
                     for n, h, g, m in _templates()])


def _known(found: Column) -> Column:
    """Those of the n-grams that any template has."""
    return F.array_intersect(_strings(sorted({g for t in _templates() for g in t[2]})), found)


def _possible(known: Column) -> Column:
    """Whether a window of a text with these n-grams may agree with a template."""
    return _bound(known, lambda k: F.exists(
        _constants(), lambda t: F.size(F.array_intersect(t["grams"], k)) >= F.size(t["grams"]) * AGREEMENT))


def _anchors() -> list[str]:
    """Words of which every window that agrees with a template holds one: without them, too few of its n-grams are left."""
    open_, chosen = [(g, AGREEMENT * len(g)) for _, _, g, _ in _templates()], []

    def left(g: list[str]) -> int:
        return sum(not set(x.split()) & set(chosen) for x in g)

    while short := [g for g, need in open_ if left(g) >= need]:
        words = sorted({w for g in short for x in g for w in x.split()} - set(chosen))
        gain = {w: sum(w in x.split() for g in short for x in g) * (len(w) if len(w) > 5 else 0.1 if w in COMMON else 1) for w in words}
        chosen.append(max(words, key=lambda w: (gain[w], w)))
    return chosen


def _anchored(text: Column) -> Column:
    return _bound(F.lower(text), lambda t: F.exists(_strings(_anchors()), lambda w: F.contains(t, w)))


def _best(found: Column) -> Column:
    return _bound(found, lambda f: _bound(_agreeing(f), lambda best: F.when(
        best.isNotNull(), F.struct(best["agreement"].alias("agreement"), (-best["minus"]).alias("class")))))


def _agreeing(found: Column) -> Column:
    """(agreement, negative class) of the template that agrees best; the first class of several. NULL if none does."""
    def one(t: Column) -> Column:
        both = F.size(F.array_intersect(t["grams"], found))
        # A window without a token agrees with nothing.
        forth, back = both / F.size(t["grams"]), F.coalesce(F.try_divide(both, F.size(F.array_distinct(found))), F.lit(0.0))
        share = F.when(t["heading"], F.when(F.least(forth, back) >= HEADING, F.least(forth, back))).otherwise(
            F.when(forth >= AGREEMENT, forth))
        named = F.size(F.array_except(t["must"], found)) == 0
        return F.struct(F.when(named, share).alias("agreement"), (-t["class"]).alias("minus"))

    return F.array_max(F.filter(F.transform(_constants(), one), lambda x: x["agreement"].isNotNull()))


def _paragraphs(lines: Column) -> Column:
    """(first, lines) of every run of lines with a letter or digit."""
    def runs(lines: Column) -> Column:
        blank = F.filter(F.transform(lines, lambda x, n: F.when(~x.rlike(r"[\p{L}\p{N}]"), n)), lambda n: n.isNotNull())
        return _bound(blank, lambda b: F.zip_with(
            F.concat(F.array(F.lit(-1)), b), F.concat(b, F.array(F.size(lines))), lambda start, end: F.struct(
                (start + 1).alias("first"), F.slice(lines, start + 2, end - start - 1).alias("lines"))))

    return F.filter(_bound(lines, runs), lambda r: F.size(r["lines"]) > 0)


def _windows(bounds: Column) -> Column:
    """(first, n) of the runs of lines, given the number of words before each line and of all."""
    starts = F.sequence(F.lit(0), F.size(bounds) - 2)
    return F.flatten(F.transform(starts, lambda i: F.transform(
        F.filter(F.sequence(F.lit(1), F.size(bounds) - 1 - i), lambda n: (n == 1) | (F.get(bounds, i + n - 1) - F.get(bounds, i) < WORDS)),
        lambda n: F.struct(i.alias("first"), n.alias("n")))))


def _apart(windows: Column) -> Column:
    """Of windows that overlap, only the best."""
    ordered = F.array_sort(F.transform(windows, lambda w: F.struct(
        (-w["best"]["agreement"]).alias("minus"), w["n"].alias("n"), w["first"].alias("first"), w["best"]["class"].alias("class"))))
    kind = "array<struct<minus:double,n:int,first:int,class:int>>"
    return F.aggregate(ordered, F.array().cast(kind), lambda kept, w: F.when(
        F.exists(kept, lambda k: (k["first"] < w["first"] + w["n"]) & (w["first"] < k["first"] + k["n"])), kept
    ).otherwise(F.concat(kept, F.array(w)).cast(kind)))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, text, template_class, agreement) of the windows that agree with a template."""
    likely = docs.where(F.when(_anchored(F.col("text")), _possible(_known(grams(F.col("text"))))))
    runs = likely.select("doc_id", F.inline(_paragraphs(F.split("text", "\n")))).where(
        _possible(_known(grams(F.array_join("lines", " ")))))
    counts = F.aggregate(
        F.col("lines"), F.array(F.lit(0)), lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + F.size(tokens(x)))))
    measured = runs.withColumn("bounds", counts).withColumn("windows", F.filter(F.transform(
        _windows(F.col("bounds")), lambda w: F.struct(
            w["first"].alias("first"), w["n"].alias("n"),
            _best(grams(F.array_join(F.slice(F.col("lines"), w["first"] + 1, w["n"]), " "))).alias("best"))),
        lambda w: w["best"].isNotNull()))
    found = measured.select("doc_id", "lines", F.col("first").alias("top"), F.inline(_apart(F.col("windows"))))
    return found.select(
        "doc_id", (F.col("top") + F.col("first")).alias("paragraph"),
        F.array_join(F.slice("lines", F.col("first") + 1, F.col("n")), "\n").alias("text"),
        F.col("class").alias("template_class"), (-F.col("minus")).alias("agreement"))


def scan(docs: DataFrame, model: Model | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, paragraph, family, probability, agreement, text) of every licence notice."""
    model = model or fit(docs, text_column)
    found = candidates(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")))
    scored = model.classifier.transform(_featured(found)).withColumn("probability", F.array_max(vector_to_array("probability")))
    return scored.where((F.col("prediction") == F.col("template_class")) & (F.col("probability") >= model.threshold)).select(
        "doc_id", "paragraph", F.get(F.array(*map(F.lit, FAMILIES)), F.col("template_class")).alias("family"),
        "probability", "agreement", "text",
    )
