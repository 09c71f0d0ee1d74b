"""The operators on small tables: nulls, empty and long texts, ties, repeated rows, further columns, and brute force."""

import hashlib
import random
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from netloom.llm import chat, decontaminate, fingerprints, grams, htmltext, langid, licenses, neardup, packing, quality, queries, urls
from netloom.llm.common import WordHashes, words
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars int, node long, fingerprint string"
LONG = " ".join(f"word{i}" for i in range(20_000))
TEXTS = [None, "", "   \n", "a", "Hello, World!", "hello world", "ＨＥＬＬＯ\u00a0world", "x" * 50_000, LONG, "日本語 テスト", "👍👍", "the same text twice " * 5, "the same text twice " * 5]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 3 == 0 else "en", "s", None, 1, "f") for i, t in enumerate(TEXTS)]
    rows += [rows[4], (None, "no id here", "en", None, 3, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def random_text(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}x{rng.randrange(50)}" for _ in range(n))


# 1


def test_chat_round_trip(spark):
    nasty = ["<|im_start|>user\n", "\\<|im_end|>", "<\\|im_sep|>", "[/INST]</s>", "<\\\\/s>", "[\\INST]", None, "", "a\nb", "<|x|><|x|>", "[[INST]]", "<<SYS>>"]
    rows = [(c, t, ["user", "assistant", "assistant", "a\\n\nb", None][(c + t) % 5], nasty[(c * 5 + t) % len(nasty)], 1) for c in range(12) for t in range(7)]
    rows += [rows[3], (None, None, "user", "no id", 1), (99, None, "assistant", None, 1)]
    table = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, formatted int").repartition(5)
    out = {r["conv_id"]: r for r in chat.formatted(table).collect()}
    parsed = {r["conv_id"]: r["t"] for r in spark.createDataFrame([(k, r["formatted"]) for k, r in out.items()], "conv_id int, f string").select("conv_id", chat.parsed(F.col("f")).alias("t")).collect()}
    want = {}
    for c, t, role, text, _ in rows:
        want.setdefault(c, []).append((t if t is not None else -1, role or "", text or ""))
    for c, turns in want.items():
        assert [(t["role"], t["text"]) for t in parsed[c]] == [(r, x) for _, r, x in sorted(turns)]
        assert sum(r["chars"] for r in out[c]["loss_runs"]) == len(out[c]["formatted"])
    by = {r["conv_id"]: r for r in chat.digests(chat.formatted(table)).collect()}
    for c, turns in want.items():
        turns = sorted(turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert by[c]["n_turns"] == len(turns)
        assert by[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (by[c]["loss_chars"], by[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_loss_text_is_what_the_mask_covers(spark):
    long = "very long </s> text " * 20_000
    table = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long), (1, 1, "assistant", long), (2, 0, "user", "x")], "conv_id int, turn int, role string, text string")
    chats = chat.formatted(table)
    by = {r["conv_id"]: r for r in chat.digests(chats).collect()}
    assert by[1]["loss_chars"] == 2 * len(long) and by[1]["loss_sha256"] == hashlib.sha256((long * 2).encode()).hexdigest() and by[2]["loss_chars"] == 0
    # Another mask gives another text: the digest follows the mask, not the roles.
    turned = chats.withColumn("loss_runs", F.transform("loss_runs", lambda r: F.struct((~r["loss"]).alias("loss"), r["chars"].alias("chars"))))
    assert {r["conv_id"]: r["loss_chars"] for r in chat.digests(turned).collect()} != {k: r["loss_chars"] for k, r in by.items()}


def test_chat_merges_turns_of_one_role(spark):
    table = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id int, turn int, role string, text string")
    assert chat.formatted(table).first()["formatted"] == "<|im_start|>user\na<|im_sep|>b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"
    assert chat.formatted(table.limit(0)).count() == 0


# 2


def test_ids_equal_the_tokenizers(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    direct, ids = Tokenizer.from_file(path), packing.Ids(path)
    rng = random.Random(5)
    odd = ["", "it's don't, 'so x.'s", "<|endoftext|> a", "e\u0301, é, ß", "A b\x1cc", "Hello!!»,", "3,4 5.", "ǅ İstanbul ΑΣ, ΑΣ.", "ä, \u0308.̈, ≠ ", "'s", " 'll,", "a\u200bb", "x<| y", "﷽ 12³, ²."]
    odd += ["".join(rng.choice("aB ,.'!\n-é9<|>ß \t\u0301") for _ in range(40)) for _ in range(300)]
    for text, found in zip(odd, ids(pa.array(odd)), strict=True):
        assert list(found) == direct.encode(text, add_special_tokens=False).ids, text


def test_ids_of_letters_that_end_in_a_mark(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    direct, ids = Tokenizer.from_file(path), packing.Ids(path)
    texts = [f"a{chr(c)}, {chr(c)}.!\nb{chr(c)}>>" for a, b in [(0x80, 0x3000), (0xA000, 0xFFFF)] for c in range(a, b) if not 0xD800 <= c <= 0xDFFF]
    for text, found in zip(texts, ids(pa.array(texts)), strict=True):
        assert list(found) == direct.encode(text, add_special_tokens=False).ids, text


def test_new_words_of_letters_go_to_the_model(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    direct, ids = Tokenizer.from_file(path), packing.Ids(path)
    letters = [c for c in map(chr, range(1 << 16)) if ids.LETTERS.fullmatch(c)]
    assert direct.normalizer.normalize_str("".join(letters)) == "".join(letters) and len(direct.pre_tokenizer.pre_tokenize_str("".join(letters))) == 1

    class Counting:
        model, given = direct.model, 0

        def encode(self, text, **options):
            self.given += len(text)
            return direct.encode(text, **options)

    ids.tokenizer = Counting()
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choice(kind) for _ in range(rng.randint(1, 12))) for _ in range(200)) for kind in ["abcdefgh", "aeiouéèñßüæœ", letters[:300], letters] for _ in range(10)] + ["A\tb\r\n\fç  ", "x" * 5000]
    for text, found in zip(texts, ids(pa.array(texts)), strict=True):
        assert list(found) == direct.encode(text, add_special_tokens=False).ids, text
    # Only the empty word, between two spaces, takes the tokenizer's whole path.
    assert ids.tokenizer.given <= len(ids.PART)


def test_packing_places_every_piece(spark, docs, empty):
    path = queries.tokenizer_path()
    out = packing.packed(docs, path, length=64).toPandas()
    ids = packing.Ids(path)
    want = []
    for r in docs.collect():
        whole = np.append(ids(pa.array([r["text"]]))[0], np.uint32(0)).astype("<u4")
        want += [(r["doc_id"] if r["doc_id"] is not None else -1, k, a, len(whole[a : a + 64]), zlib.crc32(whole[a : a + 64].tobytes())) for k, a in enumerate(range(0, len(whole), 64))]
    got = [(int(a) if a == a else -1, *map(int, rest)) for a, *rest in out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)]
    assert sorted(got) == sorted(want)
    for _, group in out.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        ends = np.append(0, group["length"].cumsum())
        assert (group["offset"].to_numpy() == ends[:-1]).all() and ends[-1] <= 64
    assert packing.packed(empty, path).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_close_to_the_bound(seed):
    rng = np.random.default_rng(seed)
    histogram = np.bincount(np.clip(rng.lognormal(5.5, 1.0, 4000).astype(int), 1, 2048), minlength=2049)
    ranges, sequences = packing.plan(histogram)
    used = np.zeros(2049, np.int64)
    filled = np.zeros(sequences, np.int64)
    for size, first, number, sequence, offset in sorted(ranges, key=lambda r: (r[3], r[4])):
        used[size] += number
        assert (filled[sequence : sequence + number] == offset).all()
        filled[sequence : sequence + number] += size
        assert first >= 0
    assert (used == histogram).all() and filled.max() <= 2048
    assert sequences <= np.ceil((histogram * np.arange(2049)).sum() / 2048) * 1.01 + 1


def test_fit_is_least_squares_without_negatives():
    histogram = np.array([0, 6, 4, 2, 3])
    patterns = packing.enumerate_patterns(4, histogram > 0)
    x = packing.fit(patterns, histogram)
    matrix = np.array([np.bincount(p, minlength=5)[1:] for p in patterns]).T
    best = min(float(((matrix @ np.array(t) - histogram[1:]) ** 2).sum()) for t in np.ndindex(*[7] * len(patterns)))
    assert (x >= 0).all() and ((matrix @ x - histogram[1:]) ** 2).sum() <= best + 1e-6


# 3


def test_licenses(spark, docs, empty):
    texts = [(i, f"Some prose before.\n{t}\nand after") for i, t in enumerate(t for ts in licenses.TEMPLATES.values() for t in ts)]
    families = [f for f, ts in licenses.TEMPLATES.items() for _ in ts]
    found = {}
    for r in licenses.scanned(spark.createDataFrame(texts, "doc_id int, text string")).collect():
        found.setdefault(r["doc_id"], set()).add(r["family"])
        assert r["paragraph"] >= 1
    assert [(texts[i][1], found.get(i)) for i, f in enumerate(families) if found.get(i) != {f}] == []
    assert licenses.scanned(docs).count() == 0 and licenses.scanned(empty).count() == 0
    twice = spark.createDataFrame([(None, "Released under the MIT License.", 1)] * 2, "doc_id long, text string, family int")
    assert [r["family"] for r in licenses.scanned(twice).collect()] == ["MIT", "MIT"]
    long = spark.createDataFrame([(1, f"{LONG}\nReleased under\nthe MIT License.\n{LONG}")], "doc_id long, text string")
    assert [r["family"] for r in licenses.scanned(long).collect()] == ["MIT"]


#: Notices that are no templates, as they are found in files: wrapped, with comment marks, in other words.
HELD_OUT = [
    ("MIT", "Released under\nthe MIT License"),
    ("MIT", "This library is released under the MIT licence"),
    ("MIT", "// Copyright 2021 Jane Doe. Use of this source code is permitted under the MIT license"),
    ("MIT", "Code licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated documentation files (the\n\"Software\"), to deal in the Software without restriction, including\nwithout limitation the rights to use, copy, modify, merge, publish,\ndistribute, sublicense, and/or sell copies"),
    ("MIT", "The above copyright notice and this permission notice shall be\nincluded in all copies or substantial portions of the Software."),
    ("Apache", "Licensed under the\nApache License, Version 2.0"),
    ("Apache", "# Licensed to the Foundation under one or more agreements; the files are under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License"),
    ("Apache", "Distributed under the Apache 2.0 license"),
    ("Apache", "This module is available under the Apache License 2.0"),
    ("Apache", "Unless required by applicable law or agreed to in writing,\nsoftware distributed under the License is distributed on an\n\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("GPL", "This file is part of Foo and is released under the GNU General Public License v2"),
    ("GPL", " * This program is free software; you can redistribute it and/or\n * modify it under the terms of the GNU General Public License\n * as published by the Free Software Foundation; either version 2"),
    ("GPL", "Licensed under the GPL v2"),
    ("GPL", "You may copy it under the GNU General Public License, version 3 or later"),
    ("LGPL", "This library may be used under the terms of the GNU Lesser General Public License"),
    ("LGPL", "Distributed under the LGPL version 2.1"),
    ("AGPL", "This server is free software under the GNU Affero General Public License"),
    ("AGPL", "Released under the AGPL v3"),
    ("BSD", "Licensed under the BSD license"),
    ("BSD", "Use of this source code is governed by a BSD-style\nlicense that can be found in the LICENSE file"),
    ("BSD", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met"),
    ("BSD", "Neither the name of the University nor the names of its contributors\nmay be used to endorse or promote products derived from this software\nwithout specific prior written permission."),
    ("MPL", "This file is subject to the terms of the Mozilla Public License, version 1.1"),
    ("MPL", "Code is available under the MPL 2.0"),
    ("CC-BY-NC", "Text and figures are licensed under CC BY-NC 3.0"),
    ("CC-BY-NC", "This book is licensed under a Creative Commons\nAttribution-NonCommercial 3.0 Unported License"),
    ("CC-BY-SA", "Content is available under CC BY-SA 3.0"),
    ("CC-BY-SA", "Licensed under the Creative Commons Attribution-ShareAlike License"),
    ("CC-BY", "All articles are licensed under a Creative Commons Attribution 3.0 License"),
    ("CC0", "This data set is dedicated to the public domain under CC0"),
    ("ISC", "Licensed under the ISC License"),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released\ninto the public domain"),
    ("Boost", "Use, modification and distribution are subject to the Boost Software License, Version 1.0"),
    ("EPL", "All rights in this program are made available under the terms of the\nEclipse Public License v1.0"),
    ("EUPL", "Licensed under the EUPL, Version 1.1"),
    ("Zlib", "Licensed under the zlib license"),
    ("OFL", "The fonts are licensed under the SIL Open Font License 1.1"),
    ("GFDL", "Permission is granted to copy and distribute this document under the terms of the GNU Free Documentation License"),
    ("Reserved", "(c) 2019 Example Press. All rights reserved"),
    ("Reserved", "No part of this book may be reproduced without the prior written permission of the publisher"),
    ("Reserved", "This code is proprietary and confidential"),
    ("unknown", "Licensed under the Quux License, version 3"),
    ("unknown", "Released under the Fnord Community Licence"),
    ("unknown", "This data is distributed under the terms of the Ruritania Open Government licence"),
    ("unknown", "SPDX-License-Identifier: Fnord-1.0"),
]
ORDINARY_LINES = [
    "the driver's license was renewed", "he had permission to visit", "mit mit mit", "Version 3 of the plan", "public domain of knowledge is large",
    "He reserved all rights of way and a table for two.", "The fishing licence costs ten pounds a year", "She works at MIT as a professor",
    "The Apache were led by Geronimo", "A license to kill is a film title", "Her licence had expired, so she took the bus",
    "The software was free of charge for a week", "The university published the names of all contributors", "You can copy the file to another folder",
    "The general public was admitted at noon", "An eclipse of the sun is due", "The copyright of the song was sold", "Poetic license is granted to few",
    "The pub lost its licence to sell beer", "The terms of the treaty were harsh", "He distributed leaflets under the bridge", "The commons were enclosed by law",
    "Attribution of the painting is disputed", "Merchants sold warranties of every kind", "They released the prisoners under guard",
]
#: The same again, written after all settings were fixed.
LATER = [
    ("MIT", "Project Foo is open source under the MIT License"), ("MIT", "MIT licensed, see the file LICENSE"), ("MIT", "copies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions"),
    ("Apache", "The code is provided under the Apache License, v2.0"), ("Apache", "See the License for the specific language governing permissions and\nlimitations under the License."), ("Apache", "You may obtain a copy of the Apache License, Version 2.0, and use this file under it"),
    ("GPL", "It is distributed under the GNU General Public License"), ("GPL", "Covered by the GPL version 3"), ("GPL", "You should have received a copy of the GNU General Public License\nalong with this script"),
    ("LGPL", "You can use the library under the GNU Lesser General Public License v3"), ("AGPL", "The web service is licensed under the GNU Affero General Public License, version 3"),
    ("BSD", "Distributed under the 3-clause BSD license"), ("BSD", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS\n\"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES"), ("BSD", "Released under a BSD-style license"),
    ("MPL", "The source is licensed under the Mozilla Public License 2.0"), ("CC-BY-NC", "Photos: CC BY-NC 2.0"), ("CC-BY-SA", "This wiki is licensed under a Creative Commons Attribution-ShareAlike 3.0 License"),
    ("CC-BY", "Slides are licensed under CC BY 4.0"), ("CC0", "The author has waived all copyright to this work under CC0"), ("ISC", "Published under the ISC license"),
    ("Unlicense", "Dedicated under the Unlicense"), ("Boost", "This header is under the Boost Software License 1.0"), ("EPL", "Licensed under the Eclipse Public License"), ("EUPL", "Made available under the EUPL 1.2"),
    ("Zlib", "This software is provided 'as-is', without any express or implied\nwarranty"), ("OFL", "Licensed under the Open Font License"), ("GFDL", "This manual is under the GNU Free Documentation License 1.2"),
    ("Reserved", "All Rights Reserved (c) Foo GmbH"), ("Reserved", "Unauthorized copying of this document, via any medium, is strictly prohibited"),
    ("unknown", "This tool is licensed under the Blorp Software License 2.1"), ("unknown", "Made available under the Zorbia Data Licence"), ("unknown", "Use of the data is governed by the Snark license"),
]
LATER_ORDINARY = [
    "Apache helicopters flew over the town", "The license plate was missing from the car", "Boost your sales with these tips", "MIT and Harvard are in Cambridge", "Permission to land was granted",
    "They redistributed the land to the poor", "A free press is subject to the law of the country", "The union published a document on wages", "No part of the cake was left", "The reserved seats were all taken",
    "His licence was revoked by the commission", "This bread is made available in most shops", "The documentation was poor, the software worse", "Source and binary stars are studied", "The work of the author is in the public library",
]

def found_families(spark, texts):
    found = {i: set() for i in range(len(texts))}
    for r in licenses.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect():
        found[r["doc_id"]].add(r["family"])
    return [found[i] for i in range(len(texts))]


def test_licenses_of_held_out_notices(spark):
    for notices, ordinary, least in ((HELD_OUT, ORDINARY_LINES, 0.9), (LATER, LATER_ORDINARY, 0.8)):
        got = found_families(spark, [t for _, t in notices])
        assert np.mean([g == {f} for g, (f, _) in zip(got, notices, strict=True)]) >= least
        assert [t for t, g in zip(ordinary, found_families(spark, ordinary), strict=True) if g] == []


def brute_licenses(text, model, s=licenses.Settings()):
    """Families of each paragraph, by the rules of the docstring, one after another."""
    out = []
    for at, part in enumerate(re.split(licenses.PARAGRAPHS, text or "")):
        ws = licenses.split_words(part)
        ps = set(licenses.pairs(ws))
        logits = np.array(model.bias) + sum((np.array(model.weights[g]) for g in {*ws, *ps} if g in model.weights), np.zeros(len(model.bias)))
        p = licenses.probabilities(logits / model.temperature)
        if not {w for g in model.weights for w in g.split()} - licenses.common_words() & set(ws):
            continue
        stands = []
        for k, family in enumerate(model.families[:-1]):
            theirs = [t for f, t in licenses.template_pairs() if f == family]
            similar, held = (max(len(ps & set(t)) / d(t) if ps and t else 0.0 for t in theirs) for d in (lambda t: min(len(ps), len(t)), len))
            names = licenses.LICENCE_WORDS if family == licenses.UNKNOWN else licenses.NAMES[family]
            named = any(n in ws or n in ps for n in names)
            likely = p[k] == p.max() and p[k] >= s.least and similar >= (s.named_overlap if named else s.overlap)
            if likely and named if family == licenses.UNKNOWN else likely or held >= 1 or named and held >= s.overlap:
                stands.append((at, family, round(float(p[k]), 4)))
        known = [x for x in stands if x[1] != licenses.UNKNOWN]
        out += known or stands
    return sorted(out)


def test_licenses_equal_brute_force(spark):
    texts = [t for _, t in HELD_OUT + LATER] + ORDINARY_LINES + ["\n".join(t for _, t in HELD_OUT[i : i + 3]) for i in range(0, 30, 3)] + ["\n\n".join(t for _, t in LATER[i : i + 3]) for i in range(0, 30, 3)]
    model = licenses.fit()
    found = {i: [] for i in range(len(texts))}
    for r in licenses.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect():
        found[r["doc_id"]].append((r["paragraph"], r["family"], round(r["score"], 4)))
    for i, t in enumerate(texts):
        want = brute_licenses(t, model)
        assert [x[:2] for x in sorted(found[i])] == [x[:2] for x in want], t
        assert np.allclose([x[2] for x in sorted(found[i])], [x[2] for x in want], atol=2e-4)


def test_licenses_equal_search_of_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = re.compile(r"(?i)licen[sc]e|reserved|copyright|\bgpl\b|creative commons|proprietary|public domain|spdx")
    want = sorted((d, i) for d, t in table.select("doc_id", "text").collect() for i, part in enumerate(re.split(licenses.PARAGRAPHS, t or "")) if words.search(part))
    found = licenses.scanned(table).collect()
    assert sorted({(r["doc_id"], r["paragraph"]) for r in found}) == want
    assert {r["family"] for r in found if "reserved" in r["notice"]} == {"Reserved"}


def test_a_pattern_of_words():
    words = {"mit", "mi", "gpl", "a0", "0", "gplv"}
    pattern = re.compile(licenses.any_of(words))
    assert all(pattern.fullmatch(w.replace("0", "27")) for w in words) and not any(pattern.fullmatch(w) for w in ("m", "g", "gp", "mitx", "a", ""))


def test_licenses_sharing_a_line(spark):
    pairs = [(a, b) for a in licenses.TEMPLATES for b in licenses.TEMPLATES if a != b]
    lines = [(i, f"{licenses.TEMPLATES[a][0]} {licenses.TEMPLATES[b][-1]}") for i, (a, b) in enumerate(pairs)]
    lines.append((len(pairs), "Licensed under the MIT License and the Apache License, Version 2.0"))
    lines.append((len(pairs) + 1, "He reserved all rights of way and a table for two."))
    found = {i: set() for i, _ in lines}
    for r in licenses.scanned(spark.createDataFrame(lines, "doc_id int, text string")).collect():
        found[r["doc_id"]].add(r["family"])
    assert [(lines[i][1], found[i]) for i, p in enumerate(pairs) if found[i] != set(p)] == []
    assert found[len(pairs)] == {"MIT", "Apache"} and found[len(pairs) + 1] == set()


# 4


def brute_classes(texts, threshold=0.8):
    idf_words = {}
    lists = [re.findall(r"\w+", (t or "").lower()) for t in texts]
    for ws in lists:
        for w in set(ws):
            idf_words[w] = idf_words.get(w, 0) + 1
    rarity = {w: np.log((1 + len(texts)) / (1 + n)) + 1 for w, n in idf_words.items()}
    weights = []
    for ws in lists:
        out = {}
        for i in range(max(1, len(ws) - 4) if ws else 0):
            part = tuple(ws[i : i + 5])
            out[part] = out.get(part, 0) + np.mean([rarity[w] for w in part])
        weights.append(out)
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = weights[i], weights[j]
            shared = sum(min(a[k], b[k]) for k in a.keys() & b.keys())
            total = sum(a.values()) + sum(b.values()) - shared
            if (a and b and shared >= threshold * total) or (not a and not b and (texts[i] or "") == (texts[j] or "")):
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    return [find(i) for i in range(len(texts))]


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", "?!", "?!", "a b", "A, b", "a b c"]
    for _ in range(12):
        base = random_text(rng, rng.randrange(20, 120)).split()
        for k in range(6):
            ws = list(base)
            for _ in range(k):
                ws[rng.randrange(len(ws))] = f"edit{rng.randrange(10**6)}"
            texts.append(" ".join(ws))
    texts += [texts[-1], texts[-6]]
    table = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, node string, sketch int").repartition(7)
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(table).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)
    assert sorted(r["doc_id"] for r in neardup.kept(table).collect()) == sorted(set(got.values()))


def test_near_duplicates_in_large_buckets(spark):
    """Many texts around one: all steps are needed, and the classes are still those of brute force."""
    rng = random.Random(3)
    base = random_text(rng, 100).split()
    texts = []
    for _ in range(150):
        ws = list(base)
        for _ in range(rng.randrange(0, 9)):
            ws[rng.randrange(len(ws))] = f"edit{rng.randrange(10**6)}"
        texts.append(" ".join(ws))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(table).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_near_duplicates_of_odd_tables(spark, docs, empty):
    got = neardup.classes(docs).collect()
    assert len(got) == docs.count() and neardup.classes(empty).count() == 0
    by = {r["doc_id"]: r["class_id"] for r in got}
    assert by[0] == by[1] == 0 and by[2] == 2 and by[4] == by[5] == 4 and by[11] == by[12] == 11 and by[None] is None
    kept = neardup.kept(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id = 4").count() == 1 and kept.filter("doc_id is null").count() == 1


def test_kept_rows_do_not_depend_on_ids(spark):
    rng = random.Random(9)
    a, b, c = (random_text(rng, 60) for _ in range(3))
    rows = [(1, a, "x"), (None, a, "y"), (2, b, "x"), (2, c, "x"), (None, c.upper(), "z"), (None, random_text(rng, 60), "n"), (3, "", "e"), (4, None, "e"), (2, b, "x"), (2, b, "w")]
    table = spark.createDataFrame(rows, "doc_id long, text string, h1 string")
    got = neardup.kept(table)
    assert got.columns == table.columns
    kept = sorted(map(tuple, got.collect()), key=repr)
    assert len(kept) == 5 and (1, a, "x") in kept and (2, c, "x") in kept and (3, "", "e") in kept and rows[5] in kept
    assert [r for r in kept if r[1] == b] in ([(2, b, "x")], [(2, b, "w")])
    assert sorted(map(tuple, neardup.kept(table.repartition(3)).collect()), key=repr) == kept


def test_blocks_of_a_bucket_meet_all(spark):
    """Comparisons dealt by blocks are those of the whole bucket."""
    rows = [(1, i, i % 7 if i < 20 else 100 + i, 1.0, 1.0, [1.0] + [0.0] * 63) for i in range(40)]
    open_ = spark.createDataFrame(rows, "key long, id long, root long, total double, shared double, parts array<float>")
    stats = spark.createDataFrame([(1, 40, 3, 0)], "key long, n long, most long, main long")
    want = {(i, j) for i in range(40) for j in range(i) if rows[i][2] != rows[j][2]}
    for block in (1, 3, 1000):
        found = neardup.crossed(open_, stats, neardup.Settings(block=block)).collect()
        assert {(r["b"], r["a"]) for r in found} == want and len(found) == len(want)


def test_pairs_of_several_buckets_are_made_once(spark):
    at = {i: [k for k in (1, 2, 3) if i % (k + 1) == 0 or i < 8] for i in range(40)}
    rows = [(k, i, i % 7 if i < 20 else 100 + i, 1.0, 1.0, [1.0] + [0.0] * 63, at[i][::-1]) for i in at for k in at[i]]
    open_ = spark.createDataFrame(rows, "key long, id long, root long, total double, shared double, parts array<float>, keys array<long>")
    stats = spark.createDataFrame([(k, sum(k in a for a in at.values()), 3, 0) for k in (1, 2, 3)], "key long, n long, most long, main long")
    roots = {r[1]: r[2] for r in rows}
    want = {(i, j) for i in roots for j in roots if i < j and roots[i] != roots[j] and set(at[i]) & set(at[j])}
    for block in (3, 1000):
        found = neardup.crossed(open_, stats, neardup.Settings(block=block)).collect()
        assert {(r["a"], r["b"]) for r in found} == want and len(found) == len(want)


def test_bounds_leave_out_what_a_text_has_alone(spark):
    """Parts hold only what another text shares, so that own words of two near copies do not make up for what each lost."""
    rng = random.Random(4)
    base = random_text(rng, 120).split()
    texts = []
    for i in range(6):
        ws = list(base)
        for k in range(i):
            ws[20 * k + i] = f"own{i}x{k}"
        texts.append(" ".join(ws))
    settings = neardup.Settings()
    idf = np.ones(neardup.CELLS, np.float32)
    sent = spark.sparkContext.broadcast(idf)
    got = {r["id"]: r for r in neardup.bounds(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), sent, settings).collect()}
    offsets, shingles, weights = neardup.features(*WordHashes()(pa.array(texts)), idf, settings.shingle)
    of = [dict(zip(shingles[a:b].tolist(), weights[a:b].tolist(), strict=True)) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert len(got) > 3
    for i, r in got.items():
        assert sum(r["parts"]) == pytest.approx(r["shared"]) and r["shared"] == pytest.approx(sum(w for s, w in of[i].items() if any(s in o for j, o in enumerate(of) if j != i)))
        for j in got:
            both = sum(min(w, of[j][s]) for s, w in of[i].items() if s in of[j])
            assert j == i or both <= sum(map(min, r["parts"], got[j]["parts"])) + 1e-3


def test_samples_agree_as_often_as_similarity_says():
    rng = np.random.default_rng(1)
    settings = neardup.Settings(bands=256, rows=4)
    a = np.unique(rng.integers(0, 1 << 48, 300).astype(np.uint64))
    shared, own = a[:240], [np.unique(rng.integers(0, 1 << 48, 60).astype(np.uint64)) for _ in range(2)]
    sets = [np.sort(np.concatenate([shared, o])) for o in own]
    offsets = np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])])
    found = neardup.sample(offsets, np.concatenate(sets), np.full(offsets[-1], 2.5, np.float32), neardup.Randoms(settings))
    assert abs((found[0] == found[1]).mean() - 240 / 360) < 0.06


def test_word_hashes_tell_words_apart():
    texts = pa.array(TEXTS[1:] + ["héllo-wörld 12", "x𝒜 y", "A\u0301b"])
    flat, offsets = words(texts)
    hashes, starts = WordHashes()(texts)
    assert (offsets == starts).all()
    known = {}
    for w, h in zip(flat.to_pylist(), hashes, strict=True):
        assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


# 5


def canonical(text):
    def nfkc(x):
        return unicodedata.normalize("NFKC", x)

    return re.sub(r"\s+", " ", nfkc(nfkc(text or "").casefold())).strip(" ")


def test_fingerprints(spark, docs, empty):
    ids = [10, 3, 700, 5, 8, 9, 4, 2, 1, 60, 61, 62, 63]
    table = spark.createDataFrame([(i, t, 1) for i, t in zip(ids, TEXTS, strict=True)], "doc_id long, text string, bucket int").repartition(4)
    got = {r["doc_id"]: r for r in fingerprints.neighbours(table).collect()}
    rows = sorted(zip(ids, TEXTS, strict=True), reverse=True)
    for i, (k, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        part = len(text) // 3
        edited = text[: len(text) - part] + after[:part]
        r = got[k]
        wide = xxhash.xxh64_hexdigest(canonical(text).encode(), seed=42)
        assert r["fingerprint"].startswith(wide) and len(r["fingerprint"]) == 32
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == float(canonical(edited) == canonical(text)) and r["near_next"] == float(canonical(after) == canonical(text))
    assert fingerprints.neighbours(docs).count() == docs.count() and fingerprints.neighbours(empty).count() == 0
    assert fingerprints.fingerprinted(docs).columns == docs.columns
    first = {r["fingerprint"]: (r["first"], r["copies"]) for r in fingerprints.groups(docs).collect()}
    assert {(0, 3), (4, 2), (5, 2), (11, 2), (None, 1)} <= set(first.values())


def test_colliding_digests_are_told_apart(spark):
    rows = spark.createDataFrame([("d", "x"), ("d", "y"), ("d", "y"), ("e", "z")], "digest string, canon string")
    found = fingerprints.collisions(rows)
    assert sorted(tuple(r) for r in found.collect()) == [("d", "x", 0), ("d", "y", 1)]
    out = fingerprints.resolved(rows, found, 2, "digest", "canon")
    assert sorted((r["digest"], r["canon"]) for r in out.collect()) == [("d", "x"), ("d:1", "y"), ("d:1", "y"), ("e", "z")]


def test_edited_texts_that_collide_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "digest", lambda canon: F.when(F.length(canon) == 9, F.lit("same")).otherwise(F.md5(canon)))
    # The edited text of 2 is "abcdefxyz", of 1 "xyz": the first shares its digest with the text of 3 by construction.
    table = spark.createDataFrame([(3, "qqqqqqqqq"), (2, "abcdefghi"), (1, "xyz")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprints.neighbours(table).collect()}
    canons = ["abcdefghi", "abcdefxyz", "qqqqqqabc", "qqqqqqqqq"]
    want = {c: "same" if i == 0 else f"same:{i}" for i, c in enumerate(canons)}
    assert got[3]["fingerprint"] == want["qqqqqqqqq"] and got[3]["edited_fingerprint"] == want["qqqqqqabc"]
    assert got[2]["fingerprint"] == want["abcdefghi"] and got[2]["edited_fingerprint"] == want["abcdefxyz"]
    assert all(r["near_edited"] == r["near_next"] == 0.0 for r in got.values())
    again = {r["text"]: r["fingerprint"] for r in fingerprints.fingerprinted(table).collect()}
    assert again["abcdefghi"] == "same" and again["qqqqqqqqq"] == "same:1"


def test_copies_alone_move_no_text_twice(spark, monkeypatch):
    def refused(canon):
        raise AssertionError("texts are read again")

    monkeypatch.setattr(fingerprints, "collisions", refused)
    table = spark.createDataFrame([(i, "the same text") for i in range(5)] + [(9, "another")], "doc_id long, text string")
    got = fingerprints.neighbours(table).collect()
    assert len(got) == 6 and len({r["fingerprint"] for r in got}) == 2 and sum(r["near_next"] for r in got) == 4.0


# 6

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{{}}</style></head><body><nav class="top"><ul><li>Home<li>About</ul></nav>
<div class="ad">Buy now {n}</div><div class="strip"><span>Always the same words</span></div><div class="body"><h1>Title &amp; {n}</h1><p>First  <b>bold</b><br>line {n}.<p>Second &lt;p&gt; {n}</div>
<form>Name <input></form><aside>See also</aside><div id="comments"><p>Nice!</div><footer>&copy; me</footer><script>var a = "</p>";</script></body></html>"""


def test_extraction(spark, empty):
    pages = [(i, f"http://h.example/{i}", PAGE.format(n=f"n{i}x{i * 7919 % 1000}"), "t") for i in range(12)]
    pages += [(100, None, None, "t"), (101, "nothing", "", "t"), (102, "http://x/", "<article><p>in</article><p>out", "t"), (103, "http://x/", "plain &eacute; text <b>x", "t"), (None, "http://x/", "<!-- a --><p>a<!-- <p>b", "t")]
    got = {r["page_id"]: r for r in htmltext.extracted(spark.createDataFrame(pages, "page_id long, url string, html string, text string")).collect()}
    for i in range(12):
        n = f"n{i}x{i * 7919 % 1000}"
        assert got[i]["text"] == f"Title & {n}\n\nFirst bold line {n}.\n\nSecond <p> {n}"  # the strip is low in the style tree
    assert [got[k]["text"] for k in (100, 101, 102, 103, None)] == ["", "", "in", "plain é text x", "a"]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert htmltext.extracted(spark.createDataFrame([], "page_id int, url string, html string")).count() == 0


SITE = [
    "<html><body><nav class='top'><ul><li>Home page</li><li>About</li></ul></nav><div class='box'><p>{a} one two</p><p>{b}</p></div><div class='strip'>always the same words</div></body></html>",
    "<html><body><nav class='top'><ul><li>Home page</li><li>{a}</li></ul></nav><div class='box'><p>{b} one</p></div><div class='strip'>always the same {a}</div></body></html>",
]


def brute_importances(pages, s):
    """Importance of each path, straight from the definitions."""
    import xml.etree.ElementTree as E

    found = {}  # path -> for each page: [(layout, kids, features)]

    def walk(element, above, page):
        classes = (element.get("class") or "").split()
        path = f"{above}/{element.tag}{''.join('.' + c for c in classes)}{'!' if element.tag == 'nav' else ''}"
        kids, layout, features = [], [], set()
        if (element.text or "").strip():
            ws = element.text.split()
            kids.append(None)
            features = set(ws) if len(ws) <= s.short else {" ".join(ws)}
        for child in element:
            name = walk(child, path, page)
            layout.append(name.rsplit("/", 1)[1])
            kids.append(name)
        found.setdefault(path, {}).setdefault(page, []).append((tuple(layout), kids, features))
        return path

    for i, p in enumerate(pages):
        walk(E.fromstring(p), "", i)

    def importance(path):
        by, m = found[path], len(found[path])
        if m == 1:
            presentation = content = 1.0
        else:
            counts = list(__import__("collections").Counter(tuple(x[0] for x in xs) for xs in by.values()).values())
            presentation = -sum(c / m * np.log(c / m) for c in counts) / np.log(m)
            pages_of = {}
            for xs in by.values():
                for f in set().union(*[x[2] for x in xs]):
                    pages_of[f] = pages_of.get(f, 0) + 1
            # A feature on k pages, one k-th on each: its entropy to the base m is log k.
            content = 1 - (np.mean([np.log(k) / np.log(m) for k in pages_of.values()]) if pages_of else 0.0)
        decay = s.decay ** len({tuple(x[0] for x in xs) for xs in by.values()})
        parts = {}
        for xs in by.values():
            for _, kids, _ in xs:
                for kid in kids:
                    parts[kid] = parts.get(kid, 0.0) + 1 / len(kids) / len(xs) / m
        return (1 - decay) * presentation + decay * sum(w * (content if kid is None else importance(kid)) for kid, w in parts.items())

    return {path: (len(found[path]), importance(path)) for path in found}


def test_style_tree_equals_brute_force(spark):
    rng = random.Random(6)
    pages = [SITE[i % 3 % 2].format(a=f"word{rng.randrange(4)}", b=" ".join(f"x{rng.randrange(9)}" for _ in range(rng.choice([2, 20])))) for i in range(11)]
    s, tables = htmltext.Settings(), htmltext.Tables(spark)
    rows = [(i, f"http://a.example/{i}", p) for i, p in enumerate(pages)] + [(100, "http://b.example/", pages[0])]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {(r["host"], r["node"]): r for r in htmltext.importances(table, s, tables).collect()}
    for host, some in (("a.example", pages), ("b.example", pages[:1])):
        want = brute_importances(some, s)
        for path, (m, value) in want.items():
            r = got.pop((host, htmltext.hashed(path)))
            assert r["pages"] == m and r["importance"] == pytest.approx(value, abs=2e-6) and r["marked"] == path.endswith("!"), path
    assert not got
    tables.drop()


def test_style_tree_alone_finds_the_matter(spark):
    """Without the rule of the article, what stands beside it goes by the tree: on all pages of a table."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    off, idle = htmltext.Settings(article=False), htmltext.Settings(article=False, importance=0.0, inside=0.0)
    with_rule, alone, nothing = ({r["page_id"]: r["text"] for r in htmltext.extracted(pages, x).collect()} for x in (htmltext.Settings(), off, idle))
    assert alone == with_rule and all(nothing[k] != alone[k] for k in alone)


def test_names_within_an_article(spark):
    html = "<article><h2 id='share-price'>Price</h2><section id='discussion'><p>Talk</p></section><div class='side-effects'>None</div><div class='share-buttons'>Share</div><div id='comments'>Nice</div><div class='related posts'>More</div></article>"
    table = spark.createDataFrame([(1, "http://x/", html), (1, "http://x/", html), (2, "http://x/", f"<article><p>{LONG}</p></article>")], "page_id long, url string, html string")
    got = [(r["page_id"], r["text"]) for r in htmltext.extracted(table).collect()]
    assert sorted(got) == [(1, "Price\n\nTalk\n\nNone")] * 2 + [(2, LONG)]


def test_low_nodes_joined_by_host_give_the_same(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 2}.example/{i}", PAGE.format(n=f"n{i}x{i * 7919 % 1000}")) for i in range(24)], "page_id long, url string, html string")
    both = [sorted(map(tuple, htmltext.extracted(pages, htmltext.Settings(broadcast_rows=n)).collect())) for n in (200_000, 0)]
    assert both[0] == both[1]


# 7 and 9


def test_language_id(spark, sf, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = langid.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 40 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    odd = spark.createDataFrame([(100_000 + i, t, None) for i, t in enumerate([None, "", "123 !!", "👍"])], "doc_id long, text string, lang string")
    more = langid.identified(docs.select("doc_id", "text", "lang").union(odd))
    assert [(r["lang_pred"], r["score"]) for r in more.filter("doc_id >= 100000").collect()] == [("und", 0.0)] * 4
    assert langid.identified(empty).count() == 0 and langid.identified(odd).count() == 4
    assert langid.accepted(docs.select("doc_id", "text", "lang").union(odd)).filter("doc_id >= 100000").count() == 0


def test_language_id_equals_plain_scoring(spark, sf):
    """Every prediction again, one n-gram after another."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    s = langid.Settings()
    model = langid.learn(docs, s)
    got = {r["doc_id"]: r for r in langid.identified(docs, s, model).collect()}
    for r in docs.select("doc_id", "text").collect()[::7]:
        text = re.sub(r"[^\w]+|[\d_]+", " ", unicodedata.normalize("NFC", r["text"] or "").lower()) if (r["text"] or "").isascii() else None
        if text is None or not re.search("[a-z]", text):
            continue
        text, counts = re.sub(" +", " ", text), {}
        for n in range(1, s.longest + 1):
            for i in range(len(text) - n + 1):
                codes = np.array([ord(c) for c in text[i : i + n]], np.uint32)
                cell = int(grams.char_grams(codes, n, s.cells)[n - 1][0])
                counts[cell] = counts.get(cell, 0) + 1
        x = {c: np.log1p(n) * model.idf[c] for c, n in counts.items()}
        norm = np.sqrt(sum(v * v for v in x.values()))
        logits = [sum(v / norm * model.weights[c, k] for c, v in x.items()) + model.bias[k] for k in range(len(model.languages))]
        p = np.exp(np.array(logits) / model.temperature)
        p /= p.sum()
        assert got[r["doc_id"]]["lang_pred"] == model.languages[int(p.argmax())] and got[r["doc_id"]]["score"] == pytest.approx(p.max(), abs=1e-5)


def test_a_label_is_learned_with_its_own_text(spark):
    rows = spark.createDataFrame([(1, "bb bb", "x"), (1, "aa aa", "y"), (2, "cc", "y"), (2, "cc", "y")], "doc_id long, text string, lang string")
    s = langid.Settings()
    labels, found = grams.collected(rows, "lang", lambda t: langid.featurise(t, s))
    want = {"x": "bb bb", "y": "cc"}
    assert sorted(labels) == ["x", "y"]
    for label, (cells, _) in zip(labels, found, strict=True):
        assert (cells == next(langid.featurise(pa.array([want[label]]), s))[0]).all()


def test_odd_rows_of_the_classifiers(spark, sf):
    """Long texts, repeated rows and clashing names change nothing for other rows."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    one = docs.select("doc_id", "text", "lang")
    more = one.withColumns({"score": F.lit("x"), "held_out": F.lit(1), "label": F.lit(2), "h": F.lit(3)}).unionByName(
        spark.createDataFrame([(-1, LONG, None, "x", 1, 2, 3)] * 2, "doc_id long, text string, lang string, score string, held_out int, label int, h int")
    )
    model = langid.learn(one)
    assert len(model.languages) == len(langid.learn(more).languages)
    for run in (lambda t: langid.identified(t, model=model), lambda t: quality.scored(t, labels)):
        a, b = ([tuple(r) for r in run(t).orderBy("doc_id").collect()] for t in (one, more))
        assert b[2:] == a and b[0] == b[1]


def test_quality_equals_plain_scoring(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    s = quality.Settings()
    model = quality.learn(docs, labels, s)
    got = {r["doc_id"]: r["score"] for r in quality.scored(docs, labels, s, model).collect()}
    for r in docs.select("doc_id", "text").collect()[::5]:
        cells = {int(c) for c in next(quality.featurise(pa.array([r["text"]], pa.string()), s))[0]}
        margin = sum(float(model.weights[c]) for c in cells) / max(len(cells), 1) ** 0.5 + model.bias
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-(model.slope * margin + model.shift))), abs=1e-6)


def test_quality_grams_are_those_of_the_text():
    s = quality.Settings()
    text, half = "Ab 12 ab ab", s.cells // 2
    plain = text.replace("1", "0").replace("2", "0")
    want = {int(grams.char_grams(np.array([ord(c) for c in plain[i : i + n]], np.uint32), n, half)[n - 1][0]) for n in (1, 2, 3) for i in range(len(plain) - n + 1)}
    shapes = [quality.hash_text("Aa"), quality.hash_text("0"), quality.hash_text("a"), quality.hash_text("a") ^ 0x5BD1E995]
    want |= {half + int(grams.char_grams(np.array(shapes[i : i + n], np.uint32), n, half)[n - 1][0]) for n in (1, 2, 3) for i in range(5 - n)}
    assert set(map(int, next(quality.featurise(pa.array([text]), s))[0])) == want


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 3, 4000)
    p = np.full((4000, 3), 0.15)
    p[np.arange(4000), labels] = 0.7
    wrong = rng.random(4000) < 0.3
    p[wrong] = np.roll(p[wrong], 1, axis=1)
    assert 3 < langid.temperature(5 * np.log(p), labels) < 12


def test_quality(spark, empty):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.scored(docs, labels)
    rows = out.join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 60 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean([[a > b for b in bad] for a in good]) > 0.97
    odd = spark.createDataFrame([(1, None, 1), (2, "", 2), (None, "x", 3)], "doc_id long, text string, score int")
    got = quality.scored(odd, labels.limit(0)).collect()
    assert [r["score"] for r in got] == pytest.approx([0.5] * 3) and [r["predicted"] for r in got] == [1, 1, 1]
    assert quality.scored(empty, labels.limit(0)).count() == 0
    one = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, None, 0)], "doc_id long, quality int, toxic int")
    assert all(r["score"] > 0.99 for r in quality.scored(odd, one).collect())


def test_descent_finds_the_margin():
    rows = [(np.array([0]), np.array([1.0])), (np.array([1]), np.array([1.0]))]
    w = quality.descend(rows, np.array([1.0, -1.0]), np.zeros(2), quality.Settings(cost=100.0, rounds=200))
    assert w[0] + w[-1] == pytest.approx(1, abs=1e-2) and w[1] + w[-1] == pytest.approx(-1, abs=1e-2)


# 8


def naive_distance(item, passage):
    best, at, before = len(item), -1, list(range(len(item) + 1))
    for j, w in enumerate(passage):
        now = [0]
        for i, x in enumerate(item, 1):
            now.append(min(before[i] + 1, now[-1] + 1, before[i - 1] + (x != w)))
        before = now
        if now[-1] < best:
            best, at = now[-1], j
    return best, at


def test_bit_parallel_distance():
    rng = random.Random(1)
    for _ in range(500):
        a = [rng.choice("abcd") for _ in range(rng.randint(1, 90))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 120))]
        assert decontaminate.distance(a, b) == naive_distance(a, b)


def test_decontamination_equals_brute_force(spark, docs, empty):
    rng = random.Random(4)
    settings = decontaminate.Settings()
    items = [(i, random_text(rng, n, 60)) for i, n in enumerate([3, 9, 20, 40, 64, 65, 100])] + [(7, None), (8, "?!")]
    texts = []
    for _, item in items[:7]:
        for edits in range(0, 18, 2):
            ws = item.split()
            for _ in range(edits):
                k = rng.randrange(len(ws))
                ws[k : k + 1] = rng.choice([[], ["new"], [ws[k], "more"]])
                ws = ws or ["z"]
            texts.append(f"{random_text(rng, 15, 60)} {', '.join(ws).upper()}. {random_text(rng, 15, 60)}")
    table = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int")
    got = {(r["doc_id"], r["item_id"]): r["errors"] for r in decontaminate.matches(table, bench, settings).collect()}
    want = {}
    for d, t in enumerate(texts):
        for i, item in items[:7]:
            ws = re.findall(r"\w+", item.lower())
            errors, _ = naive_distance(ws, re.findall(r"\w+", t.lower()))
            if errors <= settings.budget(len(ws)):
                want[d, i] = errors
    assert got == want and len(got) > 20
    small = decontaminate.Settings(block_chars=200, share=2)  # items joined to documents
    odd = table.union(table.limit(5)).union(spark.createDataFrame([(None, texts[0], 1), (900, None, 1), (901, "", 1), (902, "?!", 1)], table.schema))
    for other in (small, decontaminate.Settings(block_chars=200, percent=0)):
        plain = decontaminate.Settings(percent=other.percent)
        assert sorted(map(repr, decontaminate.matches(odd, bench, other).collect())) == sorted(map(repr, decontaminate.matches(odd, bench, plain).collect()))
        assert sorted(map(repr, decontaminate.cleaned(odd, bench, other).collect())) == sorted(map(repr, decontaminate.cleaned(odd, bench, plain).collect()))
    assert {(r["doc_id"], r["item_id"]): r["errors"] for r in decontaminate.matches(table, bench, small).collect()} == want
    assert decontaminate.matches(empty, bench, small).count() == 0 and decontaminate.cleaned(empty, bench, small).count() == 0
    assert decontaminate.cleaned(docs, bench, small).count() == docs.count()
    assert {r["doc_id"] for r in decontaminate.cleaned(table, bench).collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert decontaminate.matches(docs, bench).count() == 0 and decontaminate.matches(empty, bench).count() == 0 and decontaminate.matches(table, bench.limit(0)).count() == 0
    assert decontaminate.cleaned(docs, bench).count() == docs.count()


# 10


def test_urls(spark, tmp_path):
    cases = [
        ("http://a.example.com/en/64", "a.example.com", "/en/64", "com/en/", "block"),
        ("http://EXAMPLE.com/en/71?x", "example.com", "/en/71", "example.com/en/7", "allow"),
        ("http://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"),
        ("https://x.example.net/de/8#/", "x.example.net", "/de/8", "example.net/de/8", "block"),
        ("https://x.example.net/de/9", "x.example.net", "/de/9", "net/de/", "allow"),
        ("ftp://cheap-pills.example.org?/es/", "cheap-pills.example.org", "", None, "block"),
        ("http://www.cheap-pills.example.net/de/1", "www.cheap-pills.example.net", "/de/1", "net/de/", "allow"),
        ("http://org/es/a", "org", "/es/a", "org/es/", "block"),
        ("http://a.b/c://d.com/en/", "a.b", "/c://d.com/en/", None, "allow"),
        ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("http://", "", "", None, "allow"), ("", "", "", None, "allow"), ("http://..", "..", "", None, "allow"),
    ]
    table = spark.createDataFrame([(i, c[0], "r") for i, c in enumerate(cases)], "page_id int, url string, rule string")
    got = sorted(map(tuple, urls.judged(table).collect()))
    assert got == [(i, *c[1:]) for i, c in enumerate(cases)]
    assert urls.judged(table.limit(0)).count() == 0
    long = spark.createDataFrame([(1, f"http://a.com/en/{'x' * 100_000}", 1)] * 2, "page_id int, url string, host int")
    assert [(r["rule"], r["verdict"], len(r["path"])) for r in urls.judged(long).collect()] == [("com/en/", "block", 100_004)] * 2


def test_equal_hashes_are_told_apart_by_their_strings(tmp_path, monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda x: len(x))
    path = str(tmp_path / "index")
    urls.build(urls.entries(sites=["aa.com", "bb.com"], rules=[]), path)
    assert list(urls.Index(path).probe(["1bb.com\n", "1aa.com\n", "1cc.com\n"]) >= 0) == [True, True, False]
