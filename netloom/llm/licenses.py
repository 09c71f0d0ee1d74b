"""License scans: a trained paragraph classifier with template comparison, in Spark expressions only.

A paragraph ends at an empty line or at a line that ends a sentence (``.``, ``!``,
``?``, ``:``); lines that are merely wrapped belong together.  Words are
lower-cased; digits are alike, so versions do not matter.  Features are words and
pairs of words, as indicators.  A multinomial logistic regression with an L1
penalty is fitted on the driver to variants (cut, thinned, embedded, wrapped into
other words) of the templates below, of notices of invented licences (the class
``unknown``) and of ordinary sentences (``none``); a temperature calibrates the
probabilities on variants that the fit did not see.  Only n-grams that keep a
weight form the vocabulary; words of the ordinary sentences never do alone, so a
paragraph without a word of it is dropped before any scoring.

A prediction of a family stands if its probability reaches ``least`` and a
template of the family confirms it: the larger part of either's word pairs that
the other has is at least ``overlap`` (``named_overlap`` if the paragraph holds a
name of the family).  Notices share a paragraph, and
probabilities add up to one, so any other family stands too if the paragraph has
all pairs of one of its templates, or a name of the family and ``overlap`` of a
template's pairs.  Where no family stands, ``unknown`` does if it is likeliest with
``least`` and the paragraph says the word licence in a notice's wording
(``named_overlap`` of it): a licence, but none of those known.

The weights, the templates' pairs and the names are three tables of fixed size; a
paragraph's n-grams are exploded and joined with them, and summed.

Defined results: null and empty texts have no paragraphs; very long ones are read
whole; one row per confirmed paragraph and family, so repeated rows repeat; an
empty table gives an empty result; other columns are ignored; the doc_id may be
null.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import Tables

UNKNOWN, NONE = "unknown", "none"
#: Where a text is cut into paragraphs.
PARAGRAPHS = r"\r?\n[ \t]*\r?\n|(?<=[.!?:])[ \t]*\r?\n"

# What the families' notices say (families by SPDX-like names).
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "Apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis, without warranties or conditions of any kind, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under the GPL, version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Licensed under the LGPL, version 3.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "AGPL": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the AGPL, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "BSD": (
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the MPL 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
    ),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Released under the Unlicense.",
    ),
    "Boost": (
        "Distributed under the Boost Software License, Version 1.0.",
        "SPDX-License-Identifier: BSL-1.0",
    ),
    "EPL": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "EUPL": (
        "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission, subsequent versions of the EUPL.",
        "Licensed under the European Union Public Licence, version 1.2.",
        "SPDX-License-Identifier: EUPL-1.2",
    ),
    "Zlib": (
        "Released under the zlib License.",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    ),
    "OFL": (
        "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
        "SPDX-License-Identifier: OFL-1.1",
    ),
    "GFDL": (
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3.",
    ),
    "Reserved": (
        "All rights reserved.",
        "Copyright 2020 by the author, all rights reserved.",
        "Proprietary and confidential.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "No part of this publication may be reproduced without the prior written permission of the publisher.",
    ),
}
#: Words and pairs that only a notice of the family has; wordings are alike, names are not.
NAMES = {
    "MIT": ("mit",),
    "Apache": ("apache",),
    "GPL": ("gpl", "gnu general"),
    "LGPL": ("lgpl", "lesser general"),
    "AGPL": ("agpl", "affero general"),
    "BSD": ("bsd",),
    "MPL": ("mpl", "mozilla public"),
    "CC-BY-NC": ("by nc", "attribution noncommercial"),
    "CC-BY-SA": ("by sa", "attribution sharealike"),
    "CC-BY": ("by 0", "attribution 0"),
    "CC0": ("cc0",),
    "ISC": ("isc",),
    "Unlicense": ("unlicense",),
    "Boost": ("boost software",),
    "EPL": ("eclipse public", "epl"),
    "EUPL": ("eupl", "union public"),
    "Zlib": ("zlib",),
    "OFL": ("ofl", "open font"),
    "GFDL": ("gfdl", "free documentation"),
    "Reserved": ("rights reserved", "proprietary"),
}
#: Notices of licences that are none of these; the gap is for a name that means nothing.
FOREIGN = (
    "Licensed under the {} License, version 2.0.",
    "This work is licensed under the terms of the {} licence.",
    "Released under the {} License.",
    "Released under the {} Public Licence.",
    "Distributed under the {} license, version 1.",
    "This file is made available under the {} Licence.",
    "This software is subject to the {} license agreement.",
    "Use of this work is governed by the {} license.",
    "SPDX-License-Identifier: {}",
    "You may use this file under the terms of the {} license.",
    "Covered by the {} licence.",
)
#: Words that a notice of an unknown licence has at least one of.
LICENCE_WORDS = ("license", "licence", "licensed", "licenced", "licenses", "licences")
#: Ordinary sentences: the class none.  Their words alone tell nothing.
ORDINARY = (
    "The plan was made in the morning and it is to be done by all of us before the end of the week.",
    "You may use this or that as you like, but not for the first time and not without a reason.",
    "It is a file that can be found in the house, and any person who has a copy of it can see it.",
    "She wrote a letter to the author of the book and asked for permission to visit the library.",
    "The version of the story that is told here is free of charge and either of them may work.",
    "In law and in life, no one is required to agree to all terms or to any later changes.",
    "To use it, go to the source and follow the conditions that are met there, with or without help.",
    "He renewed the licence of the car, and the fee was paid in full at the public office.",
    "Their copyright on the song ended, and the rights to the record were sold.",
    "The general was a public figure, and the foundation of the house was the work of years.",
    "We are from here, they were there, this was then, and what is now will be for some.",
    "All related parts are distributed under the table, on a basis that is kept in writing.",
    "Only an hour went into it, and 10 of 20 came with an answer, as at an inn on an only road.",
    "The commission will decide in the event, and the authors wrote the original with fitness and purpose.",
    "A name on the product must not be used, nor the names of those who held or provided it.",
    "The union and the open market, the font of joy and the boost of an eclipse, as soon as they come.",
)
# end of fixed values


@dataclass(frozen=True)
class Settings:
    variants: int = 40
    epochs: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.01
    least: float = 0.5
    overlap: float = 0.6
    named_overlap: float = 0.35


@dataclass(frozen=True)
class Model:
    families: list[str]
    weights: dict[str, list[float]]
    bias: list[float]
    temperature: float


def split_words(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0]+", re.sub(r"[0-9]+", "0", text.lower())) if w]


def pairs(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def template_pairs() -> list[tuple[str, list[str]]]:
    """(family, distinct word pairs) of every template; a foreign notice's pairs are those on either side of its gap."""
    known = [(name, sorted(set(pairs(split_words(t))))) for name, texts in TEMPLATES.items() for t in texts]
    return known + [(UNKNOWN, sorted({p for side in t.split("{}") for p in pairs(split_words(side))})) for t in FOREIGN]


def common_words() -> set[str]:
    return {w for t in ORDINARY for w in split_words(t)}


@functools.cache
def fit(s: Settings = Settings()) -> Model:
    """The model; it depends on nothing but the values above and the settings."""
    rng = np.random.default_rng(11)
    families = [*sorted(TEMPLATES), UNKNOWN, NONE]
    ordinary = [split_words(t) for t in ORDINARY]
    common = common_words()
    rows: list[tuple[set[str], int]] = []

    def filler() -> list[str]:
        t = ordinary[rng.integers(len(ordinary))]
        a = int(rng.integers(len(t)))
        return t[a : a + int(rng.integers(2, 12))]

    def invented() -> str:
        return " ".join("".join(rng.choice(list("bcdfgklmnprstv")) + rng.choice(list("aeiou")) for _ in range(rng.integers(2, 4))) for _ in range(rng.integers(1, 3)))

    for label, name in enumerate(families):
        texts = ORDINARY if name == NONE else FOREIGN if name == UNKNOWN else TEMPLATES[name]
        for text in texts:
            for v in range(s.variants):
                t = words = split_words(text.format(invented()) if name == UNKNOWN else text)
                if v:
                    size = max(min(4, len(t)), int(len(t) * rng.uniform(0.7, 1.0)))
                    a = int(rng.integers(len(t) - size + 1))
                    words = [w for w in t[a : a + size] if rng.random() > 0.05]
                    if rng.random() < 0.4:
                        words = [*filler(), *words, *filler()]
                rows.append(({*words, *pairs(words)}, label))
    # A gram is of use if some word of it is no ordinary one; a name that means nothing is in few rows.
    found: dict[str, int] = {}
    for f, _ in rows:
        for g in f:
            found[g] = found.get(g, 0) + 1
    grams = sorted(g for g, n in found.items() if n > 4 and any(w not in common for w in g.split()))
    place = {g: i for i, g in enumerate(grams)}
    vectors = [np.array(sorted([*(place[g] for g in f if g in place), len(grams)])) for f, _ in rows]
    labels = np.array([y for _, y in rows])
    held = np.arange(len(rows)) % 5 == 4
    z, n = np.zeros((len(grams) + 1, len(families))), np.zeros((len(grams) + 1, len(families)))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        return np.where(np.abs(z[at]) <= s.l1, 0.0, -(z[at] - np.sign(z[at]) * s.l1) / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2))

    for _ in range(s.epochs):
        for i in rng.permutation(np.flatnonzero(~held)):
            at = vectors[i]
            w = weights(at)
            g = probabilities(w.sum(axis=0))
            g[labels[i]] -= 1.0
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha * w
            n[at] += g * g
    w = weights(slice(None))
    logits = np.array([w[vectors[i]].sum(axis=0) for i in np.flatnonzero(held)])
    tries = np.exp(np.linspace(-1, 2, 61))
    losses = [-np.log(probabilities(logits / t)[np.arange(len(logits)), labels[held]] + 1e-12).mean() for t in tries]
    kept = {g: [float(x) for x in np.round(w[i], 6)] for g, i in place.items() if np.abs(w[i]).max() > 1e-6}
    return Model(families, kept, [float(x) for x in np.round(w[-1], 6)], float(tries[int(np.argmin(losses))]))


def probabilities(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def any_of(words: set[str]) -> str:
    """A pattern of exactly these words, as a tree of their beginnings, so that each character is looked at about once."""
    ends, after = "" in words, {}
    for w in sorted(words - {""}):
        after.setdefault(w[0], set()).add(w[1:])
    parts = [("[0-9]+" if c == "0" else c) + (any_of(rest) if rest != {""} else "") for c, rest in after.items()]
    whole = parts[0] if len(parts) == 1 and not ends else f"(?:{'|'.join(parts)})"
    return f"{whole}?" if ends and len(parts) > 1 else f"(?:{whole})?" if ends else whole


def word_array(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[0-9]+", "0"), "[^a-z0]+"), lambda w: w != "")


def pair_array(words: Column) -> Column:
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))


def scanned(docs: DataFrame, s: Settings = Settings(), key: str = "doc_id") -> DataFrame:
    """(key, paragraph, family, score, similarity, notice) of every confirmed paragraph and family."""
    spark, model, tables = docs.sparkSession, fit(s), Tables(docs.sparkSession)
    telling = {w for g in model.weights for w in g.split()} - common_words()
    pattern = rf"(?<![a-z]){any_of(telling)}(?![a-z])"
    # One pass of a pattern spares most texts the cutting, and most paragraphs the rest.
    rows = docs.select(F.col(key).alias("key"), "text").filter(F.lower("text").rlike(pattern))
    rows = rows.select("key", F.posexplode(F.split("text", PARAGRAPHS)).alias("paragraph", "notice")).filter(F.lower("notice").rlike(pattern))
    rows = rows.select("*", word_array(F.col("notice")).alias("words"))
    hits = tables.write(rows.select("*", F.monotonically_increasing_id().alias("row")), "license-hits")
    numbers = range(len(model.families))
    weights = F.broadcast(spark.createDataFrame([(g, w) for g, w in sorted(model.weights.items())], "gram string, w array<double>"))
    theirs = [(p, i, model.families.index(name), len(t)) for i, (name, t) in enumerate(template_pairs()) for p in t]
    templates = F.broadcast(spark.createDataFrame(theirs, "gram string, template int, at int, size int"))
    names = F.broadcast(spark.createDataFrame([(g, model.families.index(f)) for f, gs in NAMES.items() for g in gs] + [(w, model.families.index(UNKNOWN)) for w in LICENCE_WORDS], "gram string, at int"))
    own = hits.select("row", F.array_distinct(pair_array(F.col("words"))).alias("pairs"), "words")
    grams = own.select("row", F.explode(F.array_union("words", "pairs")).alias("gram"))
    logits = grams.join(weights, "gram").groupBy("row").agg(F.array(*[F.sum(F.col("w")[i]) for i in numbers]).alias("sums"))
    shared = own.select("row", F.size("pairs").alias("n"), F.explode("pairs").alias("gram")).join(templates, "gram").groupBy("row", "n", "template", "at", "size").agg(F.count("*").alias("shared"))
    similar = shared.groupBy("row", "at").agg(F.max(F.col("shared") / F.least("n", "size")).alias("similarity"), F.max(F.col("shared") / F.col("size")).alias("held"))
    named = grams.join(names, "gram").select("row", "at").distinct().withColumn("named", F.lit(True))
    bias = F.array(*map(F.lit, model.bias))
    scores = similar.join(logits, "row", "left").join(named, ["row", "at"], "left")
    scores = scores.withColumn("x", F.transform(F.zip_with(F.coalesce("sums", F.array(*[F.lit(0.0)] * len(numbers))), bias, lambda a, b: a + b), lambda v: v / model.temperature))
    scores = scores.withColumn("top", F.array_max("x")).withColumn("mine", F.get("x", F.col("at")))
    score = F.exp(F.col("mine") - F.col("top")) / F.aggregate("x", F.lit(0.0), lambda t, v: t + F.exp(v - F.col("top")))
    scores = scores.select("row", "at", "similarity", "held", F.coalesce("named", F.lit(False)).alias("named"), score.alias("score"), (F.col("mine") == F.col("top")).alias("likeliest"))
    unknown = model.families.index(UNKNOWN)
    likely = F.col("likeliest") & (F.col("score") >= s.least) & (F.col("similarity") >= F.when(F.col("named"), s.named_overlap).otherwise(s.overlap))
    stands = F.when(F.col("at") == unknown, likely & F.col("named")).otherwise(likely | (F.col("held") >= 1.0) | (F.col("named") & (F.col("held") >= s.overlap)))
    known = F.max(F.col("at") != unknown).over(Window.partitionBy("row"))
    found = scores.filter(stands).withColumn("known", known).filter((F.col("at") != unknown) | ~F.col("known"))
    family = F.get(F.array(*map(F.lit, model.families)), F.col("at"))
    out = found.join(hits.select("row", "key", "paragraph", "notice"), "row")
    return out.select(F.col("key").alias(key), "paragraph", family.alias("family"), F.round("score", 6).alias("score"), F.round("similarity", 6).alias("similarity"), "notice")
