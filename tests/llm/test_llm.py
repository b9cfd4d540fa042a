"""The package's operators against brute force, on small and awkward tables."""

from __future__ import annotations

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from alphaloom.llm import common, decontaminate, html_text, licences, near_duplicates, packing, secrets, sharding, topk, toxicity, url_filter
from alphaloom.llm import queries as q

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
EXTRA = ["row", "shard", "slot", "bucket", "node", "key", "id", "host", "path", "rule", "ids", "toxic", "held"]


def table(spark, texts, start=0):
    rows = [(start + i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def awkward(spark):
    """Nulls, empty and long texts, repeated rows, a null id, and columns with clashing names."""
    base = table(spark, [None, "", "a", "same text of five words and more", "same text of five words and more", "word " * 6000, "<|endoftext|> x", "ü\u00a0\n\n  é"])
    rows = base.unionByName(base.where("doc_id = 3")).unionByName(base.where("doc_id = 2").withColumn("doc_id", F.lit(None).cast("long")))
    return rows.withColumns({c: F.lit(1) for c in EXTRA})


def empty(spark):
    return table(spark, ["x"]).limit(0)


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))


# ---- 1 toxicity


def test_toxicity_finds_labelled_words(spark):
    rng = random.Random(1)
    texts, bad = [], set()
    for i in range(400):
        t = words(rng, rng.randint(20, 80)).split()
        if i % 5 == 0:
            t.insert(rng.randrange(len(t)), rng.choice(["zorg", "blarf", "idiot"]))
            bad.add(i)
        texts.append(" ".join(t))
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i in bad)) for i in range(300)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_chain(docs, labels, max_train=280)
    got = {r["doc_id"] for r in toxicity.score(docs, model).where("toxic = 1").collect()}
    assert got == bad
    assert {r["doc_id"] for r in toxicity.without_toxic(docs, model).collect()} == set(range(400)) - bad


def test_toxicity_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit_chain(awkward(spark), labels)
    docs = table(spark, ["you are scum", "a fine day", None, ""])
    assert [r["toxic"] for r in toxicity.score(docs, model).orderBy("doc_id").collect()] == [1, 0, 0, 0]
    assert toxicity.score(awkward(spark), model).count() == 10 and toxicity.score(empty(spark), model).count() == 0
    assert toxicity.without_toxic(awkward(spark), model).columns == awkward(spark).columns


def test_toxicity_against_brute_force(spark, sf_dir):
    """op1's rows computed a second way: terms counted in plain Python, models fitted by damped least squares steps."""
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    labelled = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r["toxic"] is not None}
    by_text = {}
    for d, t in sorted(docs):
        if d in labelled:
            first, toxic = by_text.get(t, (d, 0))
            by_text[t] = (first, max(toxic, labelled[d]))
    sample = sorted((d, y, t) for t, (d, y) in by_text.items())
    held = lambda t: {x for w in set(re.findall(r"\w+", t.lower())) for x in [w, *[w[:k] + "*" for k in range(4, 8) if len(w) > k]]}
    counts = collections.defaultdict(lambda: [0, 0])
    for _, y, t in sample:
        for w in held(t):
            counts[w][y] += 1
    a, b = sum(y for _, y, _ in sample), sum(1 - y for _, y, _ in sample)
    usual = {w: c for w, c in counts.items() if sum(c) >= 3}
    least, bound = max(10.83, 2 * np.log(max(len(usual), 1) / 50)), []
    for w, (n0, n1) in usual.items():
        cells = [(n1, (n1 + n0) * a / (a + b)), (n0, (n1 + n0) * b / (a + b)), (a - n1, (a + b - n1 - n0) * a / (a + b)), (b - n0, (a + b - n1 - n0) * b / (a + b))]
        g = 2 * sum(o * np.log(o / e) for o, e in cells if o > 0)
        if g > least and n1 / a > n0 / b:
            bound.append((-g, len(w), w, n1 / (n1 + n0)))
    chosen = {}
    for _, _, w, sure in sorted(bound):
        if not any(c.endswith("*") and w.rstrip("*").startswith(c[:-1]) and chosen[c] >= sure for c in chosen):
            chosen[w] = sure
    groups = list(toxicity.LEXICON.values())
    lexicon = [w for ws in groups for w in ws]
    names = list(dict.fromkeys(lexicon + list(chosen)))

    def probability(x, w):
        return 1 / (1 + np.exp(-np.clip(np.column_stack([np.ones(len(x)), x]) @ w, -30, 30)))

    def fit(x, y):
        design, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
        ridge = np.sqrt(np.array([1e-3] + [0.5] * x.shape[1]))
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            v = np.sqrt(np.maximum(p * (1 - p), 1e-6))
            w = w + np.linalg.lstsq(np.vstack([design * v[:, None], np.diag(ridge)]), np.concatenate([(y - p) / v, -ridge * w]), rcond=None)[0]
        return w

    rows = [(held(t), y, i % 5) for i, (_, y, t) in enumerate(sample)] + [({w}, 1, k) for w in lexicon for k in range(5)] + [(set(), 0, k) for _ in lexicon for k in range(5)]
    matrix = lambda sets: np.array([[float(n in h) for n in names] for h in sets])
    x, y, fold = matrix([h for h, _, _ in rows]), np.array([float(v) for _, v, _ in rows]), np.array([k for *_, k in rows])
    of = [np.array([float(bool(h & set(ws))) for h, _, _ in rows]) for ws in groups]
    new = matrix([held(t) for _, t in docs])
    for target in [*(c * y for c in of), (np.max(of, axis=0) == 0) * y, y]:
        out = np.zeros(len(x))
        for k in range(5):
            out[fold == k] = probability(x[fold == k], fit(x[fold != k], target[fold != k]))
        new = np.column_stack([new, probability(new, fit(x, target))])
        x = np.column_stack([x, out])
    got = {r["doc_id"]: r for r in q.op1_toxicity(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for (d, _), p in zip(docs, new[:, -5:], strict=True):
        assert np.allclose([got[d][f"p_{c}"] for c in toxicity.CATEGORIES], p, atol=2e-3), d
    best = max((2 * (y[: len(sample)] * (x[: len(sample), -1] >= c)).sum() / ((x[: len(sample), -1] >= c).sum() + a), c) for c in x[: len(sample), -1])[0]
    model_said = [got[d]["toxic"] for d, _, _ in sample]
    assert best > 0.5 and sum(model_said) > 0


def test_out_of_fold_chain():
    rng = np.random.default_rng(0)
    x = rng.random((300, 5))
    first = (x[:, 0] > 0.5).astype(float)
    second = ((first > 0) & (x[:, 1] > 0.5)).astype(float)
    weights, p = toxicity.fit_chain_on(x, np.column_stack([first, second]), np.arange(300) % 5, 5)
    assert len(weights[1]) == len(weights[0]) + 1  # the second model sees the first one's probability
    assert ((p[:, 0] > 0.5) == first).mean() > 0.9 and ((p[:, 1] > 0.5) == second).mean() > 0.85


# ---- 2 top-k


def brute_top(rows, k):
    out = []
    vectors = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for i, v in vectors:
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, u, strict=False)), j) for j, u in vectors if j != i)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BYTES", 40 * 64)
    monkeypatch.setattr(topk, "QUERY_BYTES", 2 * 64)
    rng = random.Random(2)
    rows = [(i, [rng.choice([0.0, 0.1, -0.3, rng.random()]) for _ in range(8)]) for i in range(230)]
    rows += [(300 + i, [0.5] * 8) for i in range(20)] + [(400, None), (450, [None] * 8), (500, [float("nan")] * 8), (550, [float("inf")] * 8), (None, [1.0] * 8), (7000, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, k=5).collect())
    assert got == brute_top(rows, 5)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_of_large_components(spark):
    """Any finite component takes part, and products beyond 64 bits are compared exactly."""
    rows = [(0, [1e7, 0.0]), (1, [1e7, 1.0]), (2, [-1e9, 5.0]), (3, [0.25, 3e15]), (50, [1e17, 1e17]), (51, [1e17, 1e17 + 64]), (52, [-1e17, -1e16]), (53, [1e300, 1.0]), (54, [-1e300, 1.0]), (55, [1.0, 2.0]), (100, [-1e300, 1e300])]
    odd = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "q", "vec", "qb", "cb", "true", "rank")})
    got = sorted(tuple(r) for r in topk.top_k(odd, F.col("vec_id") % 50 == 0, k=5).collect())
    shown = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    assert got == [(a, r, b, shown(s)) for a, r, b, s in brute_top(rows, 5)]


def test_top_k_of_repeated_rows(spark):
    """Repeated rows count apart; a repeated id is one query a vector, and no row with its id is its candidate."""
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0, k=9).collect())
    assert [(r[0], r[2]) for r in got] == [(0, 2), (0, 1), (0, 1), (0, 1), (0, 1), (0, 2)] and [r[1] for r in got] == [1, 2, 3, 4, 5, 6]


# ---- 3 licences


def test_licences(spark):
    texts = [
        "Intro.\nReleased under the MIT License.\nEnd",
        "x\nLicensed under the Apache License, Version 2.0, the \"License\"; you may not use this file except in compliance with the License. You may obtain a copy of the License at\n http://x",
        "All rights reserved.\nLicensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.",
        "nothing here", None, "",
    ]
    got = {r["doc_id"]: (r["licences"], r["unmatched"]) for r in licences.scan_licences(table(spark, texts)).collect()}
    assert got == {0: (["MIT"], []), 1: (["Apache-2.0"], []), 2: (["CC-BY-NC-4.0"], ["RESERVED"])}
    assert licences.scan_licences(awkward(spark)).count() == 0 and licences.scan_licences(empty(spark)).count() == 0
    assert len(licences.SENTENCES) - len(licences.naming_sentences()) < 200 and set(i for _, run in licences.RULES for i in run) <= set(licences.SENTENCES.values())


MIT = """MIT License

Copyright (c) 2020 Some One

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
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
BSD = """Copyright (c) 2020, Some One
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
   this software without specific prior written permission."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""


def test_verbatim_notices(spark):
    """Wrapped at their usual width, plain and in comments, with either line end."""
    gpl_2 = GPL.replace("software:", "software;").replace("version 3", "version 2")
    want = [
        (MIT, ["MIT"], ["MIT_NAME", "MIT_GRANT", "MIT_NOTICE", "MIT_AS_IS", "MIT_LIABILITY"]),
        (BSD, ["BSD-3-Clause"], ["RESERVED", "BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_NAMES"]),
        (APACHE, ["Apache-2.0"], ["APACHE_2_HEAD", "APACHE_COMPLY", "APACHE_OBTAIN", "APACHE_AS_IS", "APACHE_SEE"]),
        (GPL, ["GPL-3.0-or-later"], ["GPL_3_PLUS", "GPL_HOPE", "GPL_DETAILS"]),
        (gpl_2, ["GPL-2.0-or-later"], ["GPL_2_PLUS", "GPL_HOPE", "GPL_DETAILS"]),
        ("SPDX-License-Identifier: MIT", ["MIT"], ["MIT_NAME"]),
        ("Not the\n\nMIT License here. Released under the. MIT license text", [], None),
        ("a.\n" + "\n" * 30000 + ":" * 30000 + "." * 30000 + " x", [], None),
    ]
    forms = [lambda t: t, lambda t: t.replace("\n", "\r\n"), lambda t: "/*\n * " + t.replace("\n", "\n * ") + "\n */", lambda t: "# " + t.replace("\n", "\n# ")]
    texts = [form(t) for t, _, _ in want for form in forms]
    got = {r["doc_id"]: (r["licences"], r["sentence_ids"]) for r in licences.scan_licences(table(spark, texts)).collect()}
    for i in range(len(texts)):
        _, found, ids = want[i // len(forms)]
        assert got.get(i, ([], None)) == (found, ids), texts[i][:100]


# ---- 4 decontamination


def distance(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row), row.index(min(row))


MORE_NOTICES = {
    "LGPL-2.1-or-later": """ * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
 *
 * This library is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
 * Lesser General Public License for more details.
""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU Affero General Public License for more details.

You should have received a copy of the GNU Affero General Public License
along with this program.
""",
    "MPL-2.0": """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.""",
    "BSL-1.0": """// Distributed under the Boost Software License, Version 1.0.
// (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)""",
    "EPL-2.0": """This program and the accompanying materials are made
available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/""",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty.  In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:""",
    "LGPL-3.0": "# SPDX-License-Identifier: LGPL-3.0-only",
    "BSD-3-Clause": "This software is licensed under the 3-Clause BSD License.",
    "WTFPL": "Everyone is permitted to copy and distribute verbatim or modified\ncopies of this license document, and changing it is allowed as long\nas the name is changed.",
}


@pytest.mark.parametrize("licence", MORE_NOTICES)
def test_notices_of_more_licences(spark, licence):
    rows = licences.scan_licences(table(spark, [f"Some code.\n\n{MORE_NOTICES[licence]}\n\nint x;"])).collect()
    assert [(r["licences"], r["unmatched"]) for r in rows] == [([licence], [])]


def test_myers():
    rng = random.Random(3)
    for _ in range(500):
        p, t = "".join(rng.choices("ab", k=rng.randint(1, 70))), "".join(rng.choices("abc", k=rng.randint(0, 90)))
        assert decontaminate.myers(p, t) == distance(p, t)


def test_leaks(spark):
    rng = random.Random(4)
    items = [words(rng, 30) for _ in range(12)]
    items_df = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(90, None), (91, ""), (92, "too short"), (None, "x" * 50)], "item_id long, text string")
    texts, want = [], {}
    for i in range(60):
        body = words(rng, 80).split()
        if i % 3 == 0:
            n = rng.randrange(12)
            t = list(decontaminate.normal(items[n]))
            for _ in range(rng.randint(0, int(0.12 * len(t)))):
                at, kind = rng.randrange(len(t)), rng.randrange(3)
                t[at : at + (kind != 2)] = [] if kind == 0 else [rng.choice("xyz")]
            body.insert(rng.randrange(len(body)), "".join(t).upper())
        texts.append(" ".join(body))
    for i, text in enumerate(texts):
        for n, item in enumerate(items):
            s = decontaminate.normal(item)
            d, _ = distance(s, decontaminate.normal(text))
            if d <= int(0.08 * len(s)):
                want[i, n] = d
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.find_leaks(table(spark, texts), items_df, block_chars=700).collect()}
    assert got == want and len(want) > 8
    twice = table(spark, [f"a {items[0]} b {items[0]} c"])
    repeated = decontaminate.find_leaks(twice.unionByName(twice).withColumns({c: F.lit(1) for c in EXTRA}), items_df).collect()
    assert [(r["distance"], r["start"]) for r in repeated] == [(0, 2)] * 2
    kept = {r["doc_id"] for r in decontaminate.without_leaks(table(spark, texts), items_df, block_chars=700).collect()}
    assert kept == set(range(60)) - {i for i, _ in want}
    assert decontaminate.find_leaks(awkward(spark), items_df).count() == 0 and decontaminate.without_leaks(awkward(spark), items_df).count() == 10
    assert decontaminate.find_leaks(table(spark, texts), items_df.limit(0)).count() == 0 and decontaminate.find_leaks(empty(spark), items_df).count() == 0


def test_short_items(spark):
    items = spark.createDataFrame([(1, "Who wrote Emma?"), (2, "中国的首都是哪里？"), (3, "art"), (4, "?!")], "item_id long, text string")
    texts = ["Quiz: who  wrote EMMA? Jane.", "who wrote emmanuel", "who wrote emmo", "请回答:中国的首都是哪里", "请回答中国的首都是哪里吗", "中国的首都", "start artist smart", "his art", "art", "", None]
    got = {(r["doc_id"], r["item_id"], r["distance"], r["start"], r["end_"]) for r in decontaminate.find_leaks(table(spark, texts), items).collect()}
    assert got == {(0, 1, 0, 5, 19), (3, 2, 0, 4, 12), (4, 2, 0, 3, 11), (7, 3, 0, 4, 7), (8, 3, 0, 0, 3)}
    assert {r["doc_id"] for r in decontaminate.without_leaks(table(spark, texts), items).collect()} == {1, 2, 5, 6, 9, 10}


# ---- 5 pages


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("just text", "just text"), ("<p>a<p>b &amp; c", "a\nb & c"), ("<script>var x='<p>no</p>'</script><p>yes", "yes"), ("<!-- <p>no</p> --><div>y<b>e</b>s</div>", "yes"),
    ('<body><nav><a>Home</a></nav><article><h1>Title</h1><p>One two,  three.\n Four.</p><p>Hm.</p></article><div class="ad">Buy now, cheap.</div><section id="comments"><p>Nice, really nice text here.</p></section><footer>c</footer>', "Title\nOne two, three. Four.\nHm."),
    ("<form>name</form><p>Body text, long enough. Yes.</p><aside>more</aside>", "Body text, long enough. Yes."),
    ("<ul><li>a, b.<li>c, d.</ul>", "a, b.\nc, d."), ("<" * 50, "<" * 50), ("<div>" * 3000 + "deep", "deep"),
])
def test_page_text(page, text):
    assert html_text.main_text(page) == text


LONG = "One sentence, and more of it. Another one, as long as that. "


@pytest.mark.parametrize(("page", "parts"), [
    (f"<body><nav><a>Home</a></nav><article><h1>Title</h1><p>Lead.</p><div><p>{LONG * 9}</p><p>{LONG * 9}</p></div></article><footer>c</footer></body>", ["Title", "Lead.", LONG * 9, LONG * 9]),
    (f"<body><div><h1><a>Title</a></h1><p>Lead, with a <a>link</a>.</p><div><p>{LONG * 20}</p></div></div></body>", ["Title", "Lead, with a link.", LONG * 20]),
    (f"<article><section>{LONG * 23}</section><section>{LONG * 2}</section></article>", [LONG * 23, LONG * 2]),
    (f"<body><ul><li><a>Home</a><li><a>About</a></ul><p><a>Home</a> | <a>About</a></p><div><section><p>{LONG * 23}</p></section></div><section><p>{LONG * 2}</p></section></body>", [LONG * 23, LONG * 2]),
])
def test_all_of_a_page_in_unequal_parts(page, parts):
    assert html_text.main_text(page).split("\n") == [p.strip() for p in parts]


@pytest.mark.parametrize(("page", "parts"), [
    (f'<body><div class="content has-sidebar"><h1>Title</h1><p>{LONG}</p></div></body>', ["Title", LONG]),
    (f'<body><div id="page" class="with-sidebar"><p>{LONG}</p></div></body>', [LONG]),
    (f'<body><article><p>{LONG * 4}</p><section class="related-work"><p>{LONG}</p></section></article></body>', [LONG * 4, LONG]),
    (f'<body><div class="widget"><h1>Title</h1><p>{LONG * 5}</p><div class="share">Share this text, now.</div></div></body>', ["Title", LONG * 5]),
    (f"<body><article><p>{LONG * 3}</p><figure><img src=x><figcaption>A caption.</figcaption></figure></article></body>", [LONG * 3, "A caption."]),
    (f'<body><article><p>{LONG * 3}</p></article><div class="related-posts"><p>{LONG}</p></div><div class="cookie-banner"><p>{LONG}</p></div><section id="comments-area"><p>{LONG * 9}</p></section></body>', [LONG * 3]),
])
def test_names_of_boilerplate(page, parts):
    assert html_text.main_text(page).split("\n") == [p.strip() for p in parts]


@pytest.mark.parametrize(("page", "parts"), [
    (f"<body>{'<div>' * 600}<nav>Home</nav><p>{LONG}</p>", [LONG]),
    (f"<body><p class=it's>{LONG}</p><p title='a > b'>Two, three.</p>", [LONG, "Two, three."]),
    (f"<body><div><ul><li><a>Home</a><li><a>About us</a></ul><h1>Title</h1><p>{LONG * 3}</p></div></body>", ["Title", LONG * 3]),
    (f"<body><div><h1>Title</h1><p>{LONG * 3}</p><table><tr><td>12<td>b</table><ul><li>One<li>Two with <a>a link</a></ul></div></body>", ["Title", LONG * 3, "12", "b", "One", "Two with a link"]),
    (f"<body><div>Home | News | About</div><div><p>{LONG * 6}</p><p>{LONG * 6}</p></div><div>Terms of use</div></body>", [LONG * 6, LONG * 6]),
])
def test_paths_choose_nodes(page, parts):
    assert html_text.main_text(page).split("\n") == [p.strip() for p in parts]


def test_the_ratios_decide(spark, sf_dir, monkeypatch):
    """The given pages without any name or element that says what is what: the ratios alone find the articles, and
    with all paths scored alike they are not found."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect()
    bare = lambda h: re.sub(r'<(/?)(?:nav|article|footer|div)\b[^>]*>', r"<\1div>", h)
    want = [html_text.main_text(r["html"]) for r in rows]
    long = [i for i, t in enumerate(want) if len(t) > 600]
    near = lambda a, b: len(set(a.split("\n")) & set(b.split("\n"))) >= 0.9 * len(set(a.split("\n")) | set(b.split("\n")))
    found = sum(near(html_text.main_text(bare(rows[i]["html"])), want[i]) for i in long)
    monkeypatch.setattr(html_text, "path_scores", lambda page, nodes, never: (np.ones(len(nodes)), 0.5))
    alike = sum(near(html_text.main_text(bare(rows[i]["html"])), want[i]) for i in long)
    assert len(long) > 30 and found >= 0.9 * len(long) and alike < 0.1 * len(long), (found, alike, len(long))


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", "<p>x, y."), (None, None, None), (1, "u", "<p>x, y.")], "page_id long, url string, html string").withColumn("text", F.lit(3))
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html_text.extract_text(df).collect()) == [(0, "", 0), (1, "x, y.", 5), (1, "x, y.", 5)]
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_article_of_the_given_pages(spark, sf_dir):
    """Exact texts of all given pages, by plain cutting of their known template."""
    import html as h

    for r in q.op5_html_text(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = [" ".join(h.unescape(p.replace("<br>", " ").replace("<b>", "").replace("</b>", "")).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


# ---- 6 near duplicates


def plain_probability_jaccard(one, two):
    """Straight from the definition; one and two are weights by shingle."""
    return sum(1 / sum(max(one.get(y, 0) / one[x], two.get(y, 0) / two[x]) for y in one.keys() | two.keys()) for x in one.keys() & two.keys())


def weighted(text):
    words_ = re.findall(r"\w+", (text or "").lower())
    runs = [tuple(words_[i : i + 5]) for i in range(len(words_) - 4)] if len(words_) >= 5 else [tuple(words_)] if words_ else []
    return {k: 1 + np.log(n) for k, n in collections.Counter(runs).items()}


def brute_classes(texts, similarity=0.8):
    sets = [weighted(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            one, two = sets[i], sets[j]
            both = one.keys() & two.keys()
            if both and min(sum(one[k] for k in both) / sum(one.values()), sum(two[k] for k in both) / sum(two.values())) >= similarity - 1e-9:
                if plain_probability_jaccard(one, two) >= similarity - 1e-12:
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    return {i: find(i) for i in range(len(texts))}


def chained_texts(rng):
    """Copies, near copies, a long chain of ones each near to the last, and texts that share half."""
    texts = [words(rng, rng.randint(60, 120)) for _ in range(25)]
    texts += [texts[0]] * 15 + [" ".join(texts[1].split()[:-2] + ["zz", "yy"]) for _ in range(3)]
    link = texts[2].split() * 2
    for i in range(40):
        link = link[:]
        link[(i * 7) % len(link)] = f"new{i}"
        texts.append(" ".join(link))
    shared = words(rng, 60)
    texts += [shared + " " + words(rng, 40) for _ in range(30)] + ["short one", "short one", "short two", None, "", ""]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [texts[i] for i in order]


@pytest.mark.parametrize("block", [512, 4])
def test_near_duplicates(spark, block):
    texts = chained_texts(random.Random(6))
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates.near_duplicate_classes(table(spark, texts), block=block, bands=40, rows=3).collect()}
    assert got == brute_classes(texts)


def test_near_duplicates_with_repeated_lines(spark):
    """Production bands: a common body with a line of its own many times, and the weights that repeats have."""
    rng = random.Random(16)
    texts = []
    for n in range(60):
        body, line = words(rng, 150), words(rng, 12)
        texts += [body + ("\n" + line) * (1 + n % 20), body + ("\n" + line) * (1 + n % 7) + " " + words(rng, n % 9)]
    want = brute_classes(texts)
    assert 20 <= sum(i != c for i, c in want.items()) <= 60
    assert {r["doc_id"]: r["class_id"] for r in near_duplicates.near_duplicate_classes(table(spark, texts)).collect()} == want


def test_near_duplicates_of_the_given_documents(spark, sf_dir):
    """The query's own parameters, on the given table: the classes of brute force over all pairs."""
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    want = {docs[i][0]: docs[c][0] for i, c in brute_classes([t for _, t in docs]).items()}
    got = {r["doc_id"]: r["class_id"] for r in q.op6_near_duplicates(spark, sf_dir).collect()}
    linked = {d for d, c in want.items() if d != c}
    assert set(got) == set(want) and sum(got[d] == want[d] for d in linked) >= 0.98 * len(linked)
    assert all(want[got[d]] == want[d] for d in got)


def test_open_buckets_in_blocks(spark):
    """One bucket of a large class, strangers and small classes, dealt in blocks of few nodes: the links of all pairs."""
    rng = random.Random(26)
    base = [words(rng, 40).split() for _ in range(6)]
    texts = []
    for n in range(90):
        t = list(base[0] if n % 3 else base[n % 6])
        t[rng.randrange(len(t))] = f"w{n}"
        texts.append(" ".join(t))
    sets = [near_duplicates.weighted_shingles(t) for t in texts]
    node = lambda i: bytearray(b"%06d" % i)
    members = spark.createDataFrame([(1, node(i)) for i in range(90)], "key long, node binary")
    first = spark.createDataFrame([(node(1), node(1)), (node(2), node(1)), (node(4), node(1))], "node binary, root binary")
    set_rows = spark.createDataFrame([(node(i), bytearray(v.tobytes()), bytearray(c.astype(np.uint32).tobytes())) for i, (v, c) in enumerate(sets)], "node binary, shingles binary, counts binary")
    want = brute_classes(texts)
    for block in (200, 16, 5):
        links = near_duplicates.unresolved_links(members, first, set_rows, 0.8, block).collect()
        more = [(int(bytes(r["a"])), int(bytes(r["b"]))) for r in links] + [(2, 1), (4, 1)]
        root = {i: i for i in range(90)}
        for _ in range(90):
            for a, b in more:
                root[a] = root[b] = min(root[a], root[b])
        assert all(want[a] == want[b] for a, b in more[:-2])
        assert len({root[i] for i in range(90)}) <= len({want[i] for i in range(90)})


def test_probability_jaccard():
    rng = np.random.default_rng(18)
    for _ in range(40):
        x, y = (np.unique(rng.integers(0, 30, 20).astype(np.uint64)) for _ in range(2))
        wx, wy = rng.integers(1, 5, len(x)).astype(float), rng.integers(1, 5, len(y)).astype(float)
        exact = plain_probability_jaccard(dict(zip(x, wx, strict=True)), dict(zip(y, wy, strict=True)))
        assert abs(near_duplicates.prob_jaccard(x, wx, y, wy) - exact) < 1e-9


def test_one_of_each(spark):
    texts = chained_texts(random.Random(7))
    kept = near_duplicates.one_of_each(table(spark, texts).withColumns({c: F.lit(1) for c in EXTRA}))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute_classes(texts).values())) and "node" in kept.columns
    rows = near_duplicates.one_of_each(awkward(spark)).collect()
    assert collections.Counter(r["text"][:9] if r["text"] else "" for r in rows)["same text"] == 1 and sum(not r["text"] for r in rows) == 2
    assert near_duplicates.near_duplicate_classes(awkward(spark)).count() == 10
    assert near_duplicates.near_duplicate_classes(empty(spark)).count() == 0 and near_duplicates.one_of_each(empty(spark)).count() == 0


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(8)
    values = rng.integers(1, 2**63, 400).astype(np.uint64)
    a, b = np.sort(values[:300]), np.sort(values[100:])
    wa, wb = rng.uniform(0.5, 4, 300), rng.uniform(0.5, 4, 300)
    one, two = dict(zip(a, wa, strict=True)), dict(zip(b, wb, strict=True))
    both = sorted(one.keys() & two.keys())
    exact = sum(1 / sum(max(one.get(y, 0) / one[x], two.get(y, 0) / two[x]) for y in one.keys() | two.keys()) for x in both)
    r = near_duplicates.prob_minhash(np.concatenate([a, b]), np.concatenate([wa, wb]), np.repeat([0, 1], 300), 2, 4000)
    assert abs((r[0] == r[1]).mean() - exact) < 0.03


def test_components(spark):
    rng, n = random.Random(9), 120
    pairs = [(i, i + 1) for i in range(40)] + [(50, i) for i in range(51, 90)] + [(rng.randrange(90, n), rng.randrange(90, n)) for _ in range(12)]
    name = lambda i: b"%04d" % i
    got = {r["node"]: r["root"] for r in near_duplicates.components(spark.createDataFrame([(bytearray(name(a)), bytearray(name(b))) for a, b in pairs], "a binary, b binary")).collect()}
    least = {}
    for _ in range(n):
        for a, b in pairs:
            least[a] = least[b] = min(least.get(a, a), least.get(b, b), a, b)
    assert {bytes(k): bytes(v) for k, v in got.items()} == {name(k): name(v) for k, v in least.items() if any(k in p and p[0] != p[1] for p in pairs)}


# ---- 7 packing


def check_packing(rows, texts, capacity=2048):
    import public_tokenizers as files
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(files.path("byte_bpe_50k.json"))
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc, text in texts.items():
        ids = [*full.encode(text or "", add_special_tokens=False).ids, 0]
        own, at = sorted(by_doc.pop(doc), key=lambda r: r["piece"]), 0
        assert len(own) == -(-len(ids) // capacity) and all(r["length"] == capacity for r in own[1:])
        for k, r in enumerate(own):
            assert (r["piece"], r["start"]) == (k, at)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    assert not by_doc
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_sequence)


def test_packing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = q.op7_packing(spark, sf_dir).collect()
    n = check_packing(rows, {r["doc_id"]: r["text"] for r in docs.collect()})
    assert n <= 1.05 * sum(r["length"] for r in rows) / 2048 + 1
    odd = awkward(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    check_packing(packing.pack(odd, with_ids=False).collect(), {r["doc_id"]: r["text"] for r in odd.collect()})
    with_ids = packing.pack(awkward(spark)).collect()
    assert len({r["sequence_id"] for r in with_ids}) >= 1 and all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in with_ids)
    assert packing.pack(empty(spark)).count() == 0


def test_packing_in_many_tasks(spark, sf_dir):
    """The number of sequences hardly depends on the number of tasks."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for tasks in (1, 8, 40):
        rows = packing.pack(docs.repartition(tasks), with_ids=False).collect()
        n = check_packing(rows, texts)
        assert n <= 1.02 * sum(r["length"] for r in rows) / 2048 + 1, (tasks, n)


def test_packing_of_long_runs(spark):
    """Runs that the rank form has no stack for, special tokens and long words, against the tokenizer file."""
    runs = [" " * 2_000_000, "\n" * 2_000_000, "a" + " " * 1_200_000 + "b<|endoftext|>", "x" * 300_000, "\u00a0\u3000" * 3000, " \n" * 70_000 + "end", "a  b\tc \x1c d\r\n" * 500, "it's ½ \u0301 9\u0663 l'ete"]
    docs = table(spark, runs)
    check_packing(packing.pack(docs, with_ids=False).collect(), dict(enumerate(runs)))


def test_bins():
    rng = random.Random(10)
    sizes = [rng.randint(1, 100) for _ in range(3000)]
    for limit in (1, 8, 64):
        bins, open_, filled = packing.BestFit(100, limit), {}, collections.Counter()
        for n in sizes:
            fits = [free for free in open_.values() if free >= n]
            b, offset = bins.place(n)
            assert offset == filled[b]
            free = 100 - filled[b]
            assert (free == min(fits)) if fits else b not in open_
            filled[b] += n
            open_.pop(b, None)
            if free - n:
                open_[b] = free - n
            if len(open_) > limit:
                fullest = min(open_.values())
                open_.pop([k for k, v in open_.items() if v == fullest][-1])
        assert max(filled.values()) <= 100


# ---- 8 secrets


def plain_spans(text):
    out = [(m.start(), m.end(), "assign") for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32], key=lambda s: (s[0], secrets.KINDS.index(s[2])))


@pytest.fixture(scope="module")
def net(spark, sf_dir):
    return secrets.fit_net(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_secrets(spark, net):
    rng = random.Random(11)
    bits = ["password", "PASSWD", "Secret", "token", "api_key", "apiKey", "api", ":", "=", '"', "'", " ", "  ", "\n", "AKIA", "ABCDEFGH12345678", "abc", "0123456789abcdef" * 2, "deadbeef", "x", ".", "ſecret", "toKen", "é", "\u00a0"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 25))) for _ in range(500)] + [None, ""]
    rows = {r["doc_id"]: r for r in secrets.scan_secrets(table(spark, texts), net).collect()}
    for i, t in enumerate(texts):
        want = plain_spans(t or "")
        assert rows[i]["base"] == secrets.listed(want)
        assert [rows[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[2] == k for s in want) for k in ("assign", "access", "hex")]
        assert [s for s in rows[i]["spans"].split(",") if s and not s.startswith("net")] == [s for s in rows[i]["base"].split(",") if s]
    assert secrets.scan_secrets(awkward(spark), net).count() == 10 and secrets.scan_secrets(empty(spark), net).count() == 0


def test_the_network_on_findings_that_it_has_not_seen(net):
    found = secrets.made_findings(900, seed=99)
    said = []
    for b, t, a, _ in found:
        p = net.probability(secrets.encode(secrets.windows(b + t + a, len(b), len(b) + len(t)))).max()
        said.append(p >= net.thresholds[secrets.shape(t)])
    y, said = np.array([v for *_, v in found]), np.array(said)
    assert said[y == 1].mean() >= 0.9 and said[y == 0].mean() <= 0.15
    # stated by the net of the part that it was not fitted on
    assert net.recall >= 0.9 and net.false_alarms <= 0.15
    spans = secrets.text_spans(["read this: pwd = 'aB3dE5gH7jK9mN2pQ4sT6vW8' and card 4111111111111111 or mail ab.cd.12-3456@x.example"], net)[0]
    assert ("net", 18, 42) in [(k, a, b) for a, b, k in spans]


def test_candidates_of_secrets():
    """Short ones, ones without digits, password characters, and long ones to their last character."""
    has = lambda text, token: token in [text[a:b] for a, b in secrets.candidates(text)]
    assert has("pwd=hunter2secret", "hunter2secret") and has("passphrase: correcthorse", "correcthorse") and has("auth = 'S3cr!t#9'", "S3cr!t#9")
    assert has("token text Qx7-" + "ab9" * 40 + " x", "Qx7-" + "ab9" * 40) and has("p = QWxhZGRpbjpvcGVuIHNlc2FtZQ== .", "QWxhZGRpbjpvcGVuIHNlc2FtZQ==") and has("pin: 83920174.", "83920174")
    assert not secrets.candidates("A sentence of ordinary language, with considerable lengthiness.") and not secrets.candidates("short1 7 a=b")
    seen = secrets.windows("k = " + "x" * 100 + "SECRET1", 4, 111)
    assert len(seen) == 5 and seen[-1][secrets.BEFORE :].startswith("x" * 33 + "SECRET1") and all(len(w) == secrets.WIDTH for w in seen)
    assert "".join(w[secrets.BEFORE : secrets.BEFORE + secrets.STEP] for w in seen[:3]) == "x" * 60


def test_the_network_is_fitted_on_all_findings_of_the_table(spark, monkeypatch):
    """More of them than the 2000 of an earlier bound, in several tasks; how the documents are dealt changes nothing."""
    rng = random.Random(5)
    texts = [f"see file{rng.randrange(10**9)}.txt and {'token = ' if i % 3 == 0 else 'entry '}{rng.getrandbits(80):020x} there" for i in range(2500)] + [None, ""]
    seen = set()
    for t in texts:
        rules = plain_spans(t or "")
        for a, b in secrets.candidates(t or ""):
            label = any(a < e and s < b for s, e, _ in rules)
            seen |= {(secrets.encode([w]).tobytes(), secrets.shape(t[a:b]), label) for w in secrets.windows(t, a, b)}
    monkeypatch.setattr(secrets, "DEAL", 1500)
    one, two = (secrets.fit_net(docs, epochs=2) for docs in (table(spark, texts).coalesce(1), table(spark, texts).repartition(5)))
    assert one.fitted == two.fitted == len(seen) > 4000 and one.recall >= 0.9 and one.false_alarms <= 0.15
    assert all((a == b).all() for a, b in zip(one.weights(), two.weights(), strict=True)) and one.thresholds == two.thresholds


def test_net_spans_by_a_second_way(spark, sf_dir, net):
    """The added spans of the given documents are those of one candidate scored at a time, unless a rule's finding touches it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(60).collect()
    for d in docs:
        text, want = d["text"] or "", []
        for a, b in secrets.candidates(text):
            p = max(float(net.probability(secrets.encode([w]))[0]) for w in secrets.windows(text, a, b))
            if p >= net.thresholds[secrets.shape(text[a:b])] and not any(a < e and s < b for s, e, _ in plain_spans(text)):
                want.append((a, b))
        assert [(a, b) for a, b, k in secrets.text_spans([text], net)[0] if k == "net"] == want


def test_redaction(spark, net):
    df = table(spark, ['x token = "0123456789abcdef0123456789abcdef01234567" y', "clean", None]).withColumns({c: F.lit(1) for c in EXTRA})
    rows = secrets.without_secrets(df, net).orderBy("doc_id").collect()
    assert [r["text"] for r in rows] == ['x [SECRET]" y', "clean", None] and [r["n_chars"] for r in rows] == [13, 5, None]


def test_ids_are_not_packed_again(spark):
    """The second pass sends places and lengths to Python, of a piece of 2048 ids three numbers; the ids are joined to them."""
    texts = [f"text {i} " * (40 + i % 300) for i in range(300)]
    packed = packing.pack(table(spark, texts).repartition(7))
    rows = packed.collect()
    plan = packed._jdf.queryExecution().executedPlan().toString()
    sent = [line for line in plan.splitlines() if "MapInArrow" in line]
    assert sent and all("ids#" not in line for line in sent)
    encode = packing._encoder(*packing_files())
    by_doc = collections.defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        by_doc[r["doc_id"]].append(r)
    assert all([i for r in sorted(own, key=lambda r: r["piece"]) for i in r["ids"]] == [*encode.ids(texts[d]), 0] for d, own in by_doc.items()) and len(by_doc) == 300
    places = collections.defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        ends = [0] + [o + n for o, n in sorted(own)]
        assert [o for o, _ in sorted(own)] == ends[:-1] and ends[-1] <= 2048
    assert len(places) <= 1.02 * sum(r["length"] for r in rows) / 2048 + 2


def packing_files() -> tuple[str, str, str]:
    import public_tokenizers as files

    return files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken"), files.PATTERN


def test_batches_of_long_rows_are_sliced():
    """Ten thousand long rows are not held as Python objects at once."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(["x" * 100_000] * 98 + [None, ""])], names=["doc_id", "text"])
    cut = list(common.sliced(iter([batch, batch.slice(0, 0), batch.slice(98)])))
    assert max(b.num_rows for b in cut) < 30 and pa.Table.from_batches(cut).to_pydict() == pa.Table.from_batches([batch, batch.slice(98)]).to_pydict()


# ---- 9 shards


def test_shards(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_BYTES", 4096)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = q.op9_sharding(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    by_shard = collections.defaultdict(list)
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 1, zlib.crc32(data), "key") and 0 <= r["shard"] < 16
        assert r["grown_shard"] in (r["shard"], 16)
        by_shard[r["shard"]].append(r)
    assert len(by_shard) == 16 and any(r["grown_shard"] == 16 for r in rows)
    for own in by_shard.values():
        own.sort(key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own))) and [r["doc_id"] for r in own] != sorted(r["doc_id"] for r in own)
    again = {r["doc_id"]: r["shard"] for r in sharding.shuffled_shards(docs.orderBy(F.desc("text")), key="doc_id", size=F.length("text"), bucket_bytes=10**9).select("row.doc_id", "shard").collect()}
    assert again == {r["doc_id"]: r["shard"] for r in rows}


def test_awkward_shards(spark, tmp_path):
    out = sharding.shuffled_shards(awkward(spark), key="doc_id", size=F.lit(1), n_shards=3)
    assert out.count() == 10 and out.select("shard", "slot").distinct().count() == 10
    sharding.write_shards(out, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 10
    assert sharding.shuffled_shards(empty(spark), key="doc_id", size=F.lit(1)).count() == 0
    mapped = awkward(spark).withColumn("held", F.create_map(F.lit("a"), F.lit(1)))
    assert sharding.shuffled_shards(mapped, key="doc_id", size=F.lit(1)).count() == 10


def test_a_task_holds_one_bucket(spark):
    """Buckets dealt by a hash come several to a task, which holds them all at once."""
    dealt = sharding._one_a_task(spark.range(3200).select("id", (F.col("id") % 32).cast("int").alias("task")), 32)
    assert {(r["task"], r["count"]) for r in dealt.groupBy(F.spark_partition_id().alias("task")).count().collect()} == {(i, 100) for i in range(32)}
    docs = table(spark, [f"text {i} " * 20 for i in range(900)])
    seen: list[str] = []
    real, sharding.written = sharding.written, lambda df, name, **options: (seen.append(df._jdf.queryExecution().executedPlan().toString()), real(df, name, **options))[1]
    try:
        sharding.shuffled_shards(docs, key="doc_id", size=F.length("text"), bucket_bytes=8192)
    finally:
        sharding.written = real
    # the rows are dealt once, and not by a hash
    assert [len(re.findall("Exchange shufflepartitionidpassthrough", plan)) for plan in seen] == [0, 1] and "SortMergeJoin" not in seen[1]


def test_shards_of_hot_keys(spark):
    """A shard that one key fills has as many buckets as its bytes need, and the order is that of the seed, not of a setting."""
    docs = table(spark, [f"text {i} " * 20 for i in range(900)]).withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")))
    run = lambda seed: {(r["row"]["text"]): (r["shard"], r["slot"]) for r in sharding.shuffled_shards(docs, key="doc_id", size=F.length("text"), n_shards=4, seed=seed, bucket_bytes=8192).collect()}
    first, before = run(1), spark.conf.get("spark.sql.shuffle.partitions")
    by_shard = collections.defaultdict(list)
    for shard, slot in first.values():
        by_shard[shard].append(slot)
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values()) and sum(map(len, by_shard.values())) == 900
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert run(1) == first and run(2) != first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


# ---- 10 urls


def judge(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(h.count(".") + 1, len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else "allow"


def test_urls(spark):
    rng = random.Random(12)
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"), ("com", "/", "allow"), ("example.com", "/en/77", "block"), ("example.com", "/en/7", "allow"), ("a.example.com", "", "block")]
    urls = [f"{rng.choice(['http', 'HTTPS', ''])}{rng.choice(['://', '://', ':/'])}{rng.choice(['', 'a.', 'WWW.', 'notan'])}{rng.choice(['example.', 'Example.', 'x.', ''])}{rng.choice(['com', 'net', 'org', 'de', 'COM'])}{rng.choice(['', '/', '/en/', '/en/7', '/en/77', '/de/', '/de/8', '/es/1', '/en'])}{rng.choice(['', 'x', '?q=/en/', '#/de/', '8'])}" for _ in range(600)]
    urls += [None, "", "://", "http://", "x://y://example.com/en/7", "http://example.com/en/7" + "z" * 5000] + ["http://example.com/en/7"] * 300
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({c: F.lit(1) for c in EXTRA})
    rules_df = spark.createDataFrame(rules, "host string, path string, verdict string")
    for size in (1024, 8):
        got = {r["i"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(df, rules_df, part_rows=size).select(F.col("row.page_id").alias("i"), "host", "path", "rule", "verdict").collect()}
        assert got == {i: judge(u, rules) for i, u in enumerate(urls)}
    assert url_filter.judge_urls(df, rules_df.limit(0)).where("verdict <> 'allow' or rule is not null").count() == 0
    assert url_filter.judge_urls(df.limit(0), rules_df).count() == 0
    twice = df.where("page_id < 5")
    assert url_filter.judge_urls(twice.unionByName(twice), rules_df).count() == 10


# ---- the pipeline


def test_pipeline(spark, sf_dir):
    """run() against the stages' meaning, worked out without Spark from the documents themselves."""
    import corpus_pipeline

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = [decontaminate.normal(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = re.compile(r"\b(?:" + "|".join(w for ws in toxicity.LEXICON.values() for w in ws) + r")\b", re.I)
    kept = {i: t for i, t in docs.items() if not bad.search(t or "")}
    order = sorted(kept)
    classes = brute_classes([kept[i] for i in order])
    kept = {order[i]: kept[order[i]] for i in sorted(set(classes.values()))}
    kept = {i: t for i, t in kept.items() if not any(s in decontaminate.normal(t) for s in items if len(s) >= decontaminate.MIN_CHARS)}
    kept = {i: secrets.redact(t, plain_spans(t)) for i, t in kept.items()}
    check_packing(corpus_pipeline.run(spark, sf_dir).collect(), kept)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]


def test_pipeline_of_awkward_documents(spark, sf_dir, tmp_path):
    """Nulls, empty and long texts, repeated rows, further columns and an empty table, through all stages."""
    import corpus_pipeline

    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    rng = random.Random(40)
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    more = table(spark, [f"you are scum {words(rng, 30)}", f"{words(rng, 20)} {item}", f"{words(rng, 20)} password = hunter2hunter2", words(rng, 3000)], start=100)
    docs = awkward(spark).unionByName(more.withColumns({c: F.lit(1) for c in EXTRA}))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    by_doc = collections.Counter(r["doc_id"] for r in rows)
    # null, empty and short texts stay, equal rows are one, the toxic document and the one with the item go
    assert set(by_doc) == {0, 1, 2, 3, 5, 6, 7, 102, 103}
    assert all(len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
    assert "[SECRET]" in kept.where("doc_id = 102").first()["text"]
    nothing = spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0
