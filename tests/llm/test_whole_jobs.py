"""Operators that must leave nothing of their input out, against brute force."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from townmeter.llm import licenses, neighbours, spans

WORDS = [f"w{i}" for i in range(4000)]


def repeated_words(texts):
    """{document: places of words in runs of spans.WORDS words that stand earlier}, by comparing all windows of words."""
    seen, out = set(), {}
    for k in sorted(texts):
        w, gone = texts[k].split(), set()
        for i in range(len(w) - spans.WORDS + 1):
            window = tuple(w[i : i + spans.WORDS])
            if window in seen:
                gone.update(range(i, i + spans.WORDS))
            seen.add(window)
        out[k] = gone
    return out


@pytest.mark.parametrize("marks", [0, 4, 15, 22, 60])
def test_passages_spliced_in_mid_sentence_are_cut(spark, marks):
    """marks: words between full stops in the passage; 0 for none."""
    rng = random.Random(marks)
    plain = lambda n: rng.choices(WORDS, k=n)
    texts, length = {}, {}
    for i in range(0, 80, 2):
        passage = plain(rng.randint(45, 90))
        if marks:
            passage = [w + "." if j % marks == marks - 1 else w for j, w in enumerate(passage)]
        for k, before in ((i, 5), (i + 1, 11)):
            texts[k] = " ".join(plain(before + rng.randint(0, 9)) + passage + plain(rng.randint(0, 30)))
        length[i + 1] = len(passage)
    want = repeated_words(texts)
    assert {k: len(v) for k, v in want.items() if v} == length
    got = {r.doc_id: r for r in spans.cut_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert set(got) == set(length)
    for k, r in got.items():
        w, left = texts[k].split(), r.text.split()
        first = next(i for i, x in enumerate(w) if left[i : i + 1] != [x])
        assert r.words_removed == len(w) - len(left) and set(range(first, first + r.words_removed)) <= want[k]
        assert r.words_removed >= length[k] / 2
    assert sum(r.words_removed for r in got.values()) >= 0.75 * sum(length.values())


def test_one_long_sentence_is_a_run(spark):
    """Sentences of spans.WORDS words or more are found alone between others; less than spans.WORDS words may stay at the end."""
    rng = random.Random(1)
    long = [" ".join(rng.choices(WORDS, k=n)) + "." for n in (20, 22, 24, 30)]
    other = lambda: " ".join(rng.choices(WORDS, k=9)) + "."
    texts = [" ".join([other(), x, other()]) for x in long * 2]
    got = {r.doc_id: r.words_removed for r in spans.cut_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert set(got) == {4, 5, 6, 7} and all(spans.WORDS <= got[i + 4] <= len(x.split()) for i, x in enumerate(long))


def test_a_text_of_one_word_is_cut_in_linear_pieces():
    assert len(spans.sentences(b"a " * 1000)) <= 1000 and spans.sentences(b" a b. ") == [(1, 5, 2)]


def test_the_scan_finds_the_results_of_a_large_table(spark, monkeypatch):
    """20,000 vectors, ten times the sample, are searched with a recall of 0.9; without the scan nothing is found."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((20_000, 32)) + rng.standard_normal((100, 32))[np.arange(20_000) % 100]
    monkeypatch.setattr(neighbours, "SAMPLE", 2000)
    assert recall(spark, x, every=50) >= 0.9
    nothing = lambda blocks, query, rows, bound, k: np.zeros(0, np.int64)
    monkeypatch.setattr(neighbours, "scan", nothing)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x[:500])], "vec_id long, embedding array<double>")
    assert neighbours.search(df, every=20).count() == 0


def test_lists_beyond_the_bound_are_passed_over_and_large_ones_split(spark, monkeypatch):
    """Far clusters: results are exact though tasks hold 64 rows, and most lists lie beyond the bound."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 16)) + 20 * rng.standard_normal((5, 16))[np.arange(1500) % 5]
    monkeypatch.setattr(neighbours, "ROWS", 64)
    monkeypatch.setattr(neighbours, "QUERIES", 16)
    assert recall(spark, x) >= 0.95
    assert neighbours._packed(np.array([3, 4, 0, 9, 2, 2]), 4) == [(0, 0, 1), (1, 1, 1), (2, 1, 1), (3, 2, 3), (4, 5, 1), (5, 5, 1)]


def recall(spark, x, k=20, every=20, **how):
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(df, every=every, **how).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert sorted(got) == list(range(0, len(x), every)) and all(len(set(v)) == k for v in got.values())
    hits = 0
    for q, found in got.items():
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(np.argsort(-score, kind="stable")[:k].tolist()) & set(found))
    return hits / (k * len(got))


def test_neighbours_come_from_probed_lists(spark, monkeypatch):
    """The sample's vectors aren't candidates: recall holds with a sample far under the rows, and falls with the lists."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 24)) + 2 * rng.standard_normal((30, 24))[np.arange(3000) % 30]
    monkeypatch.setattr(neighbours, "SAMPLE", 300)
    assert recall(spark, x) >= 0.9
    monkeypatch.setattr(neighbours, "SAMPLE", 8000)
    assert recall(spark, x) >= 0.9
    monkeypatch.setattr(neighbours, "LEAST_PROBED", 1)
    assert recall(spark, x, probed=0.0) < 0.9


APACHE = """Copyright 2020 Someone

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
BSD = """Copyright (c) 2020, Someone
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


GPL2 = """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.
"""
LGPL = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
Lesser General Public License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.
"""
AGPL = """FooBar is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public
License as published by the Free Software Foundation, version 3 of the License.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL DAMAGES.
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
"""
EPL = """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
http://www.eclipse.org/legal/epl-2.0.
"""


def test_wrapped_license_headers_are_met(spark):
    commented = lambda text: "".join(f"# {x}".rstrip() + "\n" for x in text.splitlines())
    bsd3 = BSD.replace("the copyright holder nor", "Foo Bar, Inc nor")
    texts = [APACHE, commented(APACHE), MIT, commented(MIT), GPL, commented(GPL), BSD, "Fine text.\nAll rights reserved.", "all rights\n\nreserved", bsd3]
    got = {}
    for r in licenses.licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, {})[r.rule] = (r.n_sentences, r.first_place)
    apache = lambda place: {"apache2-licensed": (4, place), "apache2-full": (4, place)}
    assert got[0] == apache(2) and set(got[1]) == set(apache(2))
    assert set(got[2]) == set(got[3]) == {"mit-full"} and got[2]["mit-full"] == (3, 4)
    assert got[4] == {"gpl3-header": (2, 0), "gpl-3-or-later": (2, 0)} and set(got[5]) == set(got[4])
    assert set(got[6]) == set(got[9]) == {"bsd2", "bsd3", "all-rights-reserved"} and got[6]["all-rights-reserved"] == (5, 1)
    assert got[7] == {"all-rights-reserved": (1, 1)} and 8 not in got


def test_other_licenses_and_tags_are_met(spark):
    texts = [GPL2, LGPL, AGPL, MPL, ISC, UNLICENSE, EPL, "/* SPDX-License-Identifier: GPL-2.0-only */\nint x;", "x\n// SPDX-License-Identifier: MIT\ny", "no license " * 100_000, None, "", "Neither the name of " + "a " * 13 + "nor the names"]
    df = spark.createDataFrame([(i, t, "r", 1) for i, t in enumerate(texts)] + [(0, GPL2, "r", 1), (None, MPL, "r", 1)], "doc_id long, text string, rule string, place int")
    got = {}
    for r in licenses.licenses(df).collect():
        got.setdefault(r.doc_id, {})[r.license] = r.n_sentences
    assert got == {
        0: {"GPL-2.0-or-later": 1}, 1: {"LGPL-2.1-or-later": 1}, 2: {"AGPL-3.0-only": 1}, 3: {"MPL-2.0": 2}, 4: {"ISC": 2}, 5: {"Unlicense": 2}, 6: {"EPL-2.0": 1}, 7: {"GPL-2.0-only": 1}, 8: {"MIT": 1}, None: {"MPL-2.0": 2},
    }


def test_every_known_sentence_has_a_trigger():
    assert all(set(s.split()) & set(licenses.TRIGGERS) for s in licenses.SENTENCES.values())
    assert {i for _, _, seq in licenses.RULES for i in seq} == set(licenses.SENTENCES)


def test_each_vector_is_sent_once_however_many_queries_there_are(spark):
    index = spark.range(300).select((F.col("id") % 6).cast("int").alias("group"), F.col("id").alias("rep"), F.array(F.lit(1.0)).alias("v"), F.col("id").cast("int").alias("list"))
    probe = lambda g: F.struct(F.lit(g).alias("group"), F.array(F.lit(g)).alias("lists"))
    probes = spark.range(50_000).select(F.col("id").alias("query"), F.lit(1.0).alias("bound"), F.array(F.lit(1.0)).alias("q"), F.array(probe(1), probe(4)).alias("probes"))
    sent = {r.asks: (r.n, r.groups) for r in neighbours.dealt(index, probes).groupBy("asks").agg(F.count("*").alias("n"), F.collect_set("group").alias("groups")).collect()}
    assert (sent[0][0], sorted(sent[0][1])) == (100, [1, 4]) and sent[1][0] == 100_000


def test_equal_scores_go_to_the_smaller_key(spark):
    rows = [(i, [float(i % 3), 1.0, 0.0]) for i in range(1, 90)] + [(200 + i, [float(i % 3), 1.0, float(i)]) for i in range(30)]
    got = {}
    for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=20, k=25).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q, v in rows:
        if q % 20 == 0:
            far = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)[:25]
            assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(far)]
