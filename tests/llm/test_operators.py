"""Operators on small tables against brute force, and on odd rows: nulls, empty texts, repeats, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import textwrap
from collections import defaultdict
from itertools import product

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trailspark.llm import ann, decontam, htmltext, licenses, linededup, ngramjoin, pieces, quality, secrets, toxicity
from trailspark.llm.entry import oracle_sql, piece_model, queries, word_ranks

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, start=0):
    return spark.createDataFrame([(start + k, t, "en", f"s{k % 7}", len(t or "")) for k, t in enumerate(texts)], DOCS)


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


#: Rows that no operator may fail on.
ODD = [None, "", " ", "\n\n", "word", "word", "x" * 200_000, "a b c d e f g", "a b c d e f g", "日本 語　テキスト \x00 ퟿", "1" * 5000 + "\n" + "$" * 50, "tab\tsep\x0bx\x0cy\rz"]


def odd(spark):
    rows = [(k, t, None, None, None) for k, t in enumerate(ODD)] + [(None, "no id here at all", "en", "s1", 3), (5, "word", None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    for clash in ("score", "predicted", "ids", "row", "cls", "gone", "found", "label", "words", "kind"):
        df = df.withColumn(clash, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)


LABELS = "doc_id long, quality int, toxic int"


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), LABELS)


PER_ROW = {
    "licenses": lambda d, s: licenses.report(d), "linededup": lambda d, s: linededup.report(d), "toxicity": lambda d, s: toxicity.report(d, labels(s, [(4, 1, 0), (5, 0, None), (None, 1, 1)])),
    "secrets": lambda d, s: secrets.report(d), "ngramjoin": lambda d, s: ngramjoin.report(d), "pieces": lambda d, s: pieces.digests(d, piece_model()), "quality": lambda d, s: quality.report(d, labels(s)),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_odd_rows_and_empty_tables(spark, name):
    out = PER_ROW[name](odd(spark), spark).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in out if r.doc_id is not None) == sorted((False, k) for k in [*range(len(ODD)), 5]) and len(out) == len(ODD) + 2
    assert PER_ROW[name](empty(spark), spark).count() == 0


def test_stages_keep_columns_on_odd_rows(spark):
    d = odd(spark)
    for f in (lambda x: toxicity.drop_toxic(x, labels(spark)), linededup.drop_lines, ngramjoin.keep_first, lambda x: decontam.drop_leaks(x, spark.createDataFrame([(1, None), (2, ""), (None, "a b")], "item_id long, text string"))):
        assert f(d).columns == d.columns and f(d).count() > 0
        assert f(empty(spark)).count() == 0


# op1


def brute(vectors, k=20):
    out = {}
    for q, x in vectors:
        if q % 20 == 0:
            near = sorted(((-sum(float(np.float32(a)) * float(np.float32(b)) for a, b in zip(x, y)), i) for i, y in vectors if i != q))
            out[q] = [i for _, i in near[:k]]
    return out


def test_nearest_equals_brute_force_with_copies_and_unusable_vectors(spark):
    rng = random.Random(1)
    good = [(k, [rng.gauss(0, 1 + k % 3) for _ in range(8)]) for k in range(300)]
    good += [(300 + k, good[3][1]) for k in range(60)]
    bad = [(1000, None), (1020, [0.0] * 8), (1040, [math.nan] + [1.0] * 7), (1060, [None] + [1.0] * 7), (1080, []), (1100, [1.0]), (1120, [math.inf] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    rows = ann.report(df).orderBy("query_id", "rank").collect()
    got = defaultdict(list)
    for r in rows:
        got[r.query_id].append(r.vec_id)
    assert dict(got) == brute(good)
    assert ann.report(df.where("vec_id >= 1000")).where("query_id = 1000").count() == 0
    assert ann.report(df.limit(0)).count() == 0


def test_forest_search_reaches_most_neighbours(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    v = [(int(k), (centres[k % 40] + 0.3 * rng.normal(size=16)).tolist()) for k in range(4000)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>")
    want = brute(v)
    got = defaultdict(set)
    for r in ann.search(df, F.col("vec_id") % 20 == 0, reach=12_000).collect():
        got[r.query_id].add(r.vec_id)
    assert sum(len(got[q] & set(w)) for q, w in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_search_reaches_most_neighbours_where_the_index_prunes(spark, monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    x = rng.normal(size=(200_000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(range(len(x)), pa.int64()), "embedding": pa.array(list(x), pa.list_(pa.float32()))}))
    settled, settle = [], ann.settle
    monkeypatch.setattr(ann, "settle", lambda *a, **b: settled.append(settle(*a, **b)) or settled[-1])
    got = defaultdict(set)
    for r in ann.search(df, F.col("vec_id") % 1000 == 7).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(7, len(x), 1000):
        s = x @ x[q]
        s[q] = -2
        hits += len(got[q] & set(np.argpartition(-s, 20)[:20].tolist()))
    assert hits >= 0.9 * 20 * 200
    assert settled[0][2] < len(x)  # not a full scan


# op2


def test_license_rules_take_the_longest_sequence(spark):
    apache = "Licensed under the Apache License, Version 2.0.\nYou may not use this file except in compliance with the License. You may obtain a copy of the License at"
    out = licenses.scan(docs(spark, ["Text. Released under the MIT License. More.", apache, "All rights reserved.\nLicensed under CC BY-NC 4.0.", "mitten license", None])).orderBy("doc_id").collect()
    assert [r.licenses for r in out] == [["MIT"], ["Apache-2.0"], ["CC-BY-NC-4.0", "Proprietary"], [], []]
    assert out[1].sentence_ids == ["ApacheLine", "ApacheMayNot", "ApacheCopy"]


def wrapped(text, lead="", end="\n"):
    return end.join(lead + line for line in textwrap.wrap(text, 72))


MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
)
APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at', "http://www.apache.org/licenses/LICENSE-2.0",
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
)
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
)
GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
)


def test_wrapped_and_commented_licences_are_found_and_sql_agrees(spark):
    cases = {}
    for name, parts in (("MIT", MIT), ("Apache-2.0", APACHE), ("BSD-3-Clause", BSD), ("GPL-3.0-or-later", GPL)):
        for lead, end in (("", "\n"), (" * ", "\n"), ("# ", "\r\n"), ("// ", "\n"), ("  ", "\n")):
            cases[(end + lead.rstrip() + end).join(wrapped(x, lead, end) for x in parts)] = name
    cases |= {
        "MIT License\nCopyright (c) 2020 X\nText": "MIT", "SPDX-License-Identifier: MIT": "MIT", "// SPDX-License-Identifier:BSD-2-Clause": "BSD-2-Clause", "This project is released under the MIT License and may be reused.": "MIT",
        "All  rights\treserved": "Proprietary", "released into the public\tdomain.": "Public-Domain", "This Source Code Form is subject to the terms of the Mozilla\nPublic License, v. 2.0.": "MPL-2.0", "It is available under the ISC license, as is that.": "ISC",
        "This is free and unencumbered software released into the public domain.": "Unlicense", "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0", "CC0 1.0 Universal\n\nText": "CC0-1.0", "is licensed under the GNU Lesser General Public License here": "LGPL",
        "mitten license under the sun": "", "": "", "We warrant nothing": "",
    }
    texts = list(cases)
    got = licenses.report(docs(spark, [*texts, None])).orderBy("doc_id").collect()
    assert [r.licenses for r in got] == [*cases.values(), ""]
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", list(enumerate([*texts, None])))
    assert sorted(c.sql(licenses.report_sql()).fetchall()) == [(r.doc_id, r.n_sentences, r.sentence_ids, r.licenses) for r in got]


def test_license_scan_is_native(spark):
    plan = licenses.report(docs(spark, ["x"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


# op3


def slow_alignment(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_equals_the_textbook(spark):
    rng = random.Random(3)
    for _ in range(50):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(1, 14))] for _ in range(2))
        assert decontam.align(np.array(a), np.array(b)) == slow_alignment(a, b)


def test_exact_and_edited_copies_of_items_are_found(spark):
    rng = random.Random(4)
    items = [words(rng, 30, 3000) for _ in range(10)]
    edited = items[1].split()
    for k in range(0, 30, 8):
        edited[k] = "zzz"
    texts = [words(rng, 200, 3000) for _ in range(40)] + [f"{words(rng, 50, 3000)} {items[0].upper()}. {words(rng, 20, 3000)}", words(rng, 10, 3000) + " " + " ".join(edited), items[2]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    d = docs(spark, texts)
    got = {(r.doc_id, r.item_id): r.score for r in decontam.find_leaks(d, bench).collect()}
    bag = decontam.Words()
    own, test = bag.of(texts), bag.of(items)
    want = {(i, k): s for i, t in enumerate(own) for k, x in enumerate(test) if (s := slow_alignment(x.tolist(), t.tolist()) / (2 * len(x))) >= 0.5}
    assert got == want and set(want) == {(40, 0), (41, 1), (42, 2)}
    assert decontam.drop_leaks(d, bench).count() == 40
    mixed = spark.createDataFrame([(1, items[0], "en", "s", 1), (1, texts[0], "en", "s", 1), (None, items[1], "en", "s", 1), (None, texts[1], "en", "s", 1)], DOCS)
    assert sorted(r.text for r in decontam.drop_leaks(mixed, bench).collect()) == sorted(texts[:2])


def test_copies_with_replaced_and_inserted_words_are_found(spark):
    rng = random.Random(8)
    items = [words(rng, n, 300) for n in (1, 2, 3, 4, 5, 9, 30, 30, 48, 60)]
    texts = [words(rng, 40, 300) for _ in range(20)]
    for item in items:
        w = item.split()
        common = sorted(w, key=lambda x: " ".join(texts).split().count(x))
        for every in (3, 4, 10):
            texts.append(f"{words(rng, 9)} {' '.join('zz' if k % every == 1 else x for k, x in enumerate(w))} {words(rng, 9)}")
        rare = set(common[: len(w) * 33 // 100])
        texts += [" ".join("zz" if x in rare else x for x in w), " qq ".join(w), " ".join(x for k, x in enumerate(w) if k % 3)]
    bench = [*enumerate(items), (6, items[9])]  # an id with two texts
    got = {(r.doc_id, r.item_id): r.score for r in decontam.find_leaks(docs(spark, texts), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    bag, want = decontam.Words(), {}
    own, test = bag.of(texts), bag.of([x for _, x in bench])
    for i, t in enumerate(own):
        for (k, _), x in zip(bench, test):
            if (score := decontam.align(x, t) / (2 * len(x))) >= 0.5:
                want[i, k] = max(score, want.get((i, k), 0))
    assert got == want and len({k for _, k in want}) == len(items)


# op4


def test_lines_on_many_sites_stay_in_the_first_document_alone(spark):
    rows = [(k, f"own line number {k}\nsame line on all sites\n\nshort", "en", f"s{k % 5}", 1) for k in range(10)] + [(10, "two sites only here", "en", "s1", 1), (11, "two sites only here", "en", "s2", 1), (12, None, "en", "s2", 1)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: (r.text, r.n_removed) for r in linededup.dedup_lines(df).collect()}
    assert got[0] == ("own line number 0\nsame line on all sites\n\nshort", 0) and got[7] == ("own line number 7\n\nshort", 1)
    assert got[10] == got[11] == ("two sites only here", 0) and got[12] == (None, 0)


# op5


def test_disguised_words_are_restored(spark):
    rng = random.Random(5)
    plain = "idiot stupid moron worthless the and that with from this house garden window little green".split()
    cost = toxicity.lm(toxicity.lm_counts(docs(spark, [" ".join(rng.choice(plain) for _ in range(200)) for _ in range(20)])))
    for said, meant in (("1d10t", "idiot"), ("st.u.p.i.d", "stupid"), ("m0r0n!!", "moron"), ("stuuuupid", "stupid"), ("Garden,", "garden"), ("w0rthl3ss", "worthless")):
        assert meant in toxicity.readings(said, cost)
    texts = ["you s t u p i d thing", "plain", None, "you s. t. u. p. i. d.", "a st up id man", "so stuupid", "ssttuuppiidd", "an idiiot", "the !diot", "st u p id", "is it so, as he is"]
    assert toxicity.Words(cost, {"stupid": 0, "idiot": 1}).of(texts) == [{0}, set(), set(), {0}, {0}, {0}, {0}, {1}, {1}, {0}, set()]


def test_decoding_is_the_best_of_all_paths(monkeypatch):
    cost, rng = np.random.default_rng(1).uniform(0.1, 5, (28, 28, 28)), random.Random(2)

    def slow(token):
        best = None
        for ways in product(*toxicity.lattice(token)):
            a = b = 0
            x, said = 0.0, ""
            for c, channel in ways:
                x += channel
                if c:
                    s = toxicity.state(c)
                    x, a, b, said = x + cost[a, b, s], b, s, said + c
            best = min(best or (math.inf,), (x + cost[a, b, 0], said))
        return best[1]

    for flush in (1, 3, 256):
        monkeypatch.setattr(toxicity, "FLUSH", flush)
        for _ in range(150):
            token = "".join(rng.choice("ab1!0$.-cc8@") for _ in range(rng.randint(1, 8)))
            assert toxicity.restore(token, cost) == slow(token)


def test_scores_equal_the_logistic_model_on_each_texts_words(spark):
    rng = random.Random(14)
    plain = "idiot stupid moron the and that with from this house garden window little green".split()
    texts = [" ".join(rng.choice([*plain, "1d10t", "stuupid!", "(moron)"]) for _ in range(rng.randint(0, 12))) for _ in range(60)] + [None, ""]
    cost = toxicity.lm(toxicity.lm_counts(docs(spark, texts)))
    known = {"idiot": 0, "stup*": 1, "moron": 2, "house": 3}
    model = toxicity.Model(cost, known, np.array([2.0, 1.5, 1.0, -1.0]), -0.5)
    got = {r.doc_id: r.score for r in toxicity.score(docs(spark, texts), model).collect()}
    for k, text in enumerate(texts):
        said = {x for w in (text or "").split() for r in [*toxicity.readings(w, cost), *toxicity.edge_readings(w, cost)] for x in toxicity.features(r)}
        assert math.isclose(got[k], 1 / (1 + math.exp(0.5 - sum(model.weights[i] for f, i in known.items() if f in said))))


def planted(spark, n=600):
    rng, rows, marks = random.Random(6), [], []
    for k in range(n):
        bad, junk = rng.random() < 0.2, rng.random() < 0.3
        text = words(rng, 30) + (" " + rng.choice(["idiot", "scum", "1diot"]) if bad else "")
        rows.append((k, " ".join(w + "###" for w in text.split()) if junk and not bad else text, "en", "s", 1))
        marks.append((k, int(not (junk and not bad)), int(bad)))
    return spark.createDataFrame(rows, DOCS), labels(spark, marks), marks


@pytest.mark.parametrize("module, at, cut", [(toxicity, 2, 0.3), (quality, 1, 0.7)])
def test_classifiers_hold_out_and_hit(spark, module, at, cut):
    import zlib

    d, y, marks = planted(spark)
    out = {r.doc_id: r for r in module.report(d, y).collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= cut) for k, r in out.items())
    held = [(out[m[0]].predicted, m[at]) for m in marks if out[m[0]].held_out]
    assert sum(a == b for a, b in held) >= 0.93 * len(held)


def test_quality_scores_equal_the_mean_of_all_features(spark):
    rng = np.random.default_rng(4)
    model = quality.Model(rng.normal(size=quality.BUCKETS), 0.1)
    texts = ["one two two three", "a", "", None, "words and words " * 50, "é日 x"]
    got = {r.doc_id: r.score for r in quality.score(docs(spark, texts), model).collect()}
    for k, text in enumerate(texts):
        ids, counts = quality.bag(text)
        mean = (model.weights[ids] * counts).sum() / max(1, counts.sum()) if len(ids) else 0.0
        assert math.isclose(got[k], 1 / (1 + math.exp(-mean - 0.1)))


def test_training_lowers_the_loss():
    rng = random.Random(16)
    bags = [quality.bag(" ".join(rng.choice(["good fine text", "junk ### junk"][y].split()) for _ in range(20))) for y in (0, 1) * 40]
    model = quality.fit(bags, np.array((0, 1) * 40))
    score = lambda b: (model.weights[b[0]] * b[1]).sum() / b[1].sum() + model.bias
    assert all((score(b) > 0) == (k % 2 == 1) for k, b in enumerate(bags))


# op6


def test_base_patterns_equal_a_plain_scan(spark):
    rng = random.Random(7)
    parts = ["password: hunter2xx", "PassWD = 'abc'", "api_key=Zz9/+._=-q", "token:\x20\x20x1x2x3", "AKIA" + "A1" * 9, "AKIAshort", "deadbeef" * 4, "0" * 23, "é日 x", "Secret\" :\"p@ss", "apikey:aaaaaa=bbb"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 8))) for _ in range(200)] + [None]
    got = {r.doc_id: r for r in secrets.report(docs(spark, texts)).collect()}
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for k, t in enumerate(texts):
        base = [("assign", *m.span()) for m in assign.finditer(t or "") if len(m[2]) >= 6] + [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 20] + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 24]
        base.sort(key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))
        assert got[k].base_sha256 == hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in base).encode()).hexdigest()
        assert (got[k].n_assign, got[k].n_access, got[k].n_hex) == tuple(sum(x[0] == kind for x in base) for kind in ("assign", "access", "hex"))


def slow_guess_cost(value, rank):
    """The least over all ways to cut a value into pieces, each of one kind, by the kinds' own definitions."""
    n, low = len(value), value.lower()

    def piece(i, j):
        own, small, costs = value[i:j], low[i:j], []
        if 3 <= j - i <= secrets.LONGEST and small in rank:
            costs.append(math.log10(rank[small]) + (0 if own == small else math.log10(2 * (j - i))))
        digits = re.sub(r"[-/._]", "", own)
        if re.fullmatch(r"(19|20)\d\d([-/._]?)(0[1-9]|1[0-2])\2(0[1-9]|[12]\d|3[01])", own) or re.fullmatch(r"(0[1-9]|[12]\d|3[01])([-/._]?)(0[1-9]|1[0-2])\2(19|20)\d\d", own):
            costs.append(math.log10(36500))
        elif re.fullmatch(r"(19|20)\d\d", digits) and digits == own:
            costs.append(math.log10(150))
        whole = lambda joined: j - i >= 3 and all(joined(low[k], low[k + 1]) for k in range(i, j - 1)) and not (i and joined(low[i - 1], low[i])) and not (j < n and joined(low[j - 1], low[j]))
        if whole(lambda a, b: a == b):
            costs.append(secrets.char_cost(own[0]) + math.log10(j - i))
        if whole(lambda a, b: a + b in secrets.STEP or a + b in "abcdefghijklmnopqrstuvwxyz"):
            costs.append(math.log10(47) + math.log10(j - i))
        return min([c + math.log10(2) for c in costs] + ([secrets.char_cost(own)] if j - i == 1 else []), default=math.inf)

    def cuts(i):
        if i == n:
            yield 0.0
        for j in range(i + 1, n + 1):
            if (c := piece(i, j)) < math.inf:
                yield from (c + rest for rest in cuts(j))

    return min(cuts(0))


def test_guess_cost_is_least_over_all_segmentations():
    rank = secrets.ranked(None)
    for v in ("password1", "qwertyuiop", "aaaaaaaa", "2024-05-17x", "x9$Kq!2mZp", "Monkey1999", "31.12.2001ab", "abcdqwe11111"):
        assert abs(secrets.guess_cost(v) - slow_guess_cost(v, rank)) < 1e-9
    assert secrets.guess_cost("password1") < secrets.guess_cost("pqsswxrd1") and secrets.guess_cost("") == 0
    assert [k for k, *_ in secrets.scan("login pwd: x9$Kq!2mZpQ7 and pwd: password")] == ["cost"]


def test_a_vocabulary_ranks_words():
    own = word_ranks()
    assert len(secrets.ranked(own)) > 20_000 and secrets.ranked(own)["password"] == 1
    assert secrets.guess_cost("implementation", own) < 6 < 10 < secrets.guess_cost("xqzvbkjwplmrthgd", own)
    assert secrets.scan("password: implementation", vocabulary=own)[-1:] == [("assign", 0, 24)] and ("cost", 10, 26) in secrets.scan("password: xqzvbkjwplmrthgd", vocabulary=own)


def test_values_of_letters_and_quoted_values_are_scored_whole():
    for text, value in (
        ("pwd: xkQjzVwplmTr", "xkQjzVwplmTr"), ("passphrase=KqZxVbnmWpLtRyHs now", "KqZxVbnmWpLtRyHs"), ('pwd = "a;9,<Kq>2\'mZ"', "a;9,<Kq>2'mZ"),
        ("{'auth': 'x, y; z9 $Kq!2'}", "x, y; z9 $Kq!2"), ('credential: "Zk\\"9,v;Qm2x"', 'Zk\\"9,v;Qm2x'), ('pwd: "x9$Kq!2mZpQ7', "x9$Kq!2mZpQ7"),
    ):
        assert [text[a:b] for kind, a, b in secrets.scan(text) if kind == "cost"] == [value]
    assert secrets.scan('pwd: "password" and pwd: correcthorse') == []


# op7


def slow_components(texts, n, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        m = min(n, len(w))
        sets.append({tuple(w[k : k + m]) for k in range(len(w) - m + 1)} if w else set())
    par = list(range(len(texts)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                par[max(a, b)] = min(a, b)
    return {k: (len(sets[k]), find(k)) for k in range(len(texts))}


def test_only_candidates_of_the_join_have_prefixes_of_further_orders(spark, monkeypatch):
    """Of 80 texts two are near copies: no table holds more than a few rows of the second order."""
    rng, held, cut = random.Random(3), [], ngramjoin.cut
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(200)) for _ in range(79)]
    texts.append(texts[0] + " more words")

    def seen(df):
        out = cut(df)
        held.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(ngramjoin, "cut", seen)
    got = {r.doc_id: r.component_id for r in ngramjoin.find_components(docs(spark, texts), 5, 80).collect()}
    assert len(set(got.values())) == 79
    assert max(n for columns, n in held if "p2" in columns) < 10


@pytest.mark.parametrize("n, percent, small, bin_weight", [(4, 85, 4, 3000), (5, 80, 4, 3000), (4, 85, ngramjoin.SMALL, ngramjoin.BIN), (5, 80, 2, ngramjoin.BIN)])
def test_components_equal_brute_force(spark, monkeypatch, n, percent, small, bin_weight):
    monkeypatch.setattr(ngramjoin, "SMALL", small)
    monkeypatch.setattr(ngramjoin, "SHARED", 2)
    monkeypatch.setattr(ngramjoin, "BIN", bin_weight)
    rng, texts = random.Random(8), [None, "", "a b", "A  B", "a", "a b c d"]
    for size, copies, edits in ((60, 40, 2), (30, 6, 1), (120, 12, 3), (25, 5, 4)):
        base = words(rng, size, 5000).split()
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(len(own))] = f"e{rng.randrange(9999)}"
            texts.append(" ".join(own))
    shared = words(rng, 30, 5000)
    texts += [f"{words(rng, 20, 5000)} {shared}" for _ in range(25)] + [words(rng, 40, 5000) for _ in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.find_components(docs(spark, texts), n, percent).collect()}
    assert got == slow_components(texts, n, percent)


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(12)
    base, other = words(rng, 60, 5000), words(rng, 60, 5000)
    rows = [(5, base), (5, other), (1, base), (1, base), (7, base + " more"), (None, base), (None, other + " end"), (None, "alone " * 9), (None, "alone " * 9), (9, None), (9, None), (9, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    kept = sorted(((r.doc_id, r.text) for r in ngramjoin.keep_first(df).collect()), key=repr)
    assert kept == sorted([(1, base), (5, other), (None, "alone " * 9), (9, None), (9, None), (9, "")], key=repr)


# op8


def test_ids_equal_the_librarys(spark):
    sp = pieces.load(piece_model())
    assert pieces.crossing_pieces(sp) == []
    rng = random.Random(9)
    texts = ["".join(rng.choice(" ▁ab é日\t\n😀x.1  the") for _ in range(rng.randint(0, 40))) for _ in range(500)] + [None, "", " ", "▁", "  two  ", "x" * 3000]
    out = {r.doc_id: r for r in pieces.decode(pieces.encode(docs(spark, texts), piece_model()), piece_model()).collect()}
    for k, t in enumerate(texts):
        ids = sp.encode(t or "", add_eos=True)
        assert out[k].ids == ids and out[k].text == sp.decode(ids)


# op9


LONG = "<p>A long first paragraph, with text enough.</p><p>Another one that is as long as the first.</p><p>And a third one, which ends the article here.</p>"
LONG_TEXT = "A long first paragraph, with text enough.\n\nAnother one that is as long as the first.\n\nAnd a third one, which ends the article here."


@pytest.mark.parametrize(
    "html, text",
    [
        ("<body><nav><a href=x>Menu</a></nav><article><h1>T &amp; U</h1><p>One  two<br>three<p>Four</article><footer>f</footer>", "T & U\n\nOne two three\n\nFour"),
        ("<div id=menu><a>a</a><a>b</a></div><div class=content><p>A long first paragraph, with text enough.</p><p>Another one that is as long as the first.</p></div><div class='comments'><p>I like this page very much, thank you for it.</p></div>", "A long first paragraph, with text enough.\n\nAnother one that is as long as the first."),
        ("<article><p>x</p><script>var a='<p>no</p>'</script><style>p{}</style><form>f</form><aside>s</aside><div class='ad'>buy</div><ul><li>one</li><li>two</li></ul><!-- c --></article>", "x\n\none\n\ntwo"),
        (f"<body class='has-sidebar'><div class='site has-sidebar'><div id=menu><a>a</a><a>b</a></div><div class='content no-comments'>{LONG}</div><div class='sidebar-left'><p>Something else entirely that is here.</p></div></div>", LONG_TEXT),
        (f"<form id=page><nav><a>x</a></nav><div class=main>{LONG}</div></form>", LONG_TEXT),
        (f"<article>{LONG}<h2>References</h2><ul><li><a href=1>First work</a></li><li><a>Second</a></li></ul><div class='follow-up'><p>More.</p></div><div class='side by side'><p>Beside.</p></div><div class='ad-slot'>Buy</div><section id='comments'><p>Nice post I like it very much thank you.</p></section></article>", LONG_TEXT + "\n\nReferences\n\nFirst work\n\nSecond\n\nMore.\n\nBeside."),
        (f"<header><h1>Site</h1></header><article><header><h1>Title</h1></header>{LONG}<footer>by me</footer></article><article>{LONG}</article><div>copyright somebody</div>", f"Title\n\n{LONG_TEXT}\n\n{LONG_TEXT}"),
        (f"<div><h1>Head</h1>{LONG}</div><div class=related><p>Related text of some length that is as dense as any of the others in here.</p></div>", "Head\n\n" + LONG_TEXT),
        ("", ""), (None, ""), ("just text", "just text"), ("<p>unclosed <b>bold", "unclosed bold"), ("<article></article>", ""),
    ],
)
def test_main_text(html, text):
    assert htmltext.main_text(html) == text


def test_densities_and_choice_equal_their_definitions():
    rng = random.Random(15)

    def page(depth):
        tag = rng.choice(["div", "p", "section", "ul", "li", "a", "b"])
        inner = "".join(page(depth - 1) if depth and rng.random() < 0.6 else " ".join("x" * rng.randint(1, 9) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 4)))
        return f"<{tag}>{inner}</{tag}>"

    def every(node):
        yield node
        for x in htmltext.kids_of(node):
            yield from every(x)

    for _ in range(60):
        tree = htmltext.Tree()
        tree.feed(page(5))
        tree.close()
        keep = htmltext.chosen(tree.root)
        text = lambda node: sum(len(" ".join(x.split())) for n in every(node) for x in n.parts if isinstance(x, str))
        in_links = lambda node: text(node) if node.name == "a" else sum(in_links(x) for x in htmltext.kids_of(node))
        base = in_links(tree.root) / max(1, text(tree.root))

        def dense(node):
            c, lc = text(node), in_links(node)
            t, lt = (sum(n is not node for n in every(node)), sum(n.name == "a" for n in every(node) if n is not node))
            return c / max(1, t) * max(0.0, math.log(max(1.0001, c / max(1, lc) * max(1, t) / max(1, lt)), math.log(c / max(1, c - lc) * max(1, lc) + base * c + math.e))) if c else 0.0

        blocks = [n for n in every(tree.root) if n.name in htmltext.BLOCK]
        total = lambda node: sum(dense(x) for x in htmltext.kids_of(node))
        most = max(map(total, blocks))
        assert any(id(n) in keep and math.isclose(total(n), most) for n in blocks) or not most


def test_deep_and_long_pages_take_linear_time():
    assert htmltext.main_text("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    assert htmltext.main_text("<b>" * 20_000 + "</section>" * 20_000 + "<p>x") == "x"
    assert len(htmltext.main_text("<p>" + "word " * 1_000_000)) == 4_999_999


def test_pages_with_odd_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>" * 3000 + "deep"), (None, None, None), (1, "u", "<article>é&eacute;</article>")], "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit("clash"))
    assert sorted((r.text, r.n_chars) for r in htmltext.extract(df).collect()) == [("", 0), ("deep", 4), ("éé", 2)]
    assert htmltext.extract(df.limit(0)).count() == 0


def test_each_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in queries()) == list(range(1, 14)) and set(oracle_sql()) <= set(queries())


def test_nearest_of_equal_scores_are_the_smallest_ids(spark):
    """Distinct vectors with the same inner product: every vector of signs that agrees with the query in as many places."""
    rows = [(k, [1.0, *(1.0 if k >> i & 1 else -1.0 for i in range(7))]) for k in range(128)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    got = defaultdict(list)
    for r in ann.report(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert dict(got) == brute(rows)


def test_benchmark_words_of_arrow_slices_are_those_of_python():
    """Words are split, trimmed and lowered as str does, on Arrow's own rows: no text goes through Python."""
    texts = [None, "", " ", "The (CAT)\u00a0sat.\x1con\u2003it", "Stra\u00dfe \u00c4RGER, \u201e\u0130stanbul\u201c \u039f\u0394\u039f\u03a3 ... x", "a" * 200 + " " + "a" * 199]
    want = [[w for w in (w.strip(decontam.EDGE).lower() for w in (t or "").split()) if w] for t in texts]
    got = decontam.Words().of(pa.array([*texts, "cat"], pa.string()).slice(0, len(texts)))
    assert [len(h) for h in got] == [len(w) for w in want]
    pairs = {(w, h) for words, hashes in zip(want, got) for w, h in zip(words, hashes.tolist())}
    assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs}) and 0 not in {h for _, h in pairs}


def test_a_block_of_queries_keeps_as_many_rows_however_many_vectors_go_by():
    rng = np.random.default_rng(9)
    x, y, n, found = rng.integers(-2, 3, (700, 4)).astype(float), rng.integers(-2, 3, (6000, 4)).astype(float), 8, []
    leaf, ids = rng.integers(0, n, len(y)), rng.permutation(len(y)) + 10_000
    ways = [np.sort(rng.choice(n, rng.integers(1, n), replace=False)) for _ in x]
    near = ann.Near(5)
    for at in (slice(0, 300), slice(300, 700)):
        near.ask(np.arange(700)[at], x[at], np.concatenate(ways[at]), np.array([len(w) for w in ways[at]]))
    for k in range(n):
        for at in range(0, (own := np.flatnonzero(leaf == k)).size, 3):  # fewer at once than are kept
            near.meet(k, ids[own[at : at + 3]], y[own[at : at + 3]])
        found.append(len(near.rows_found()[0]))
    assert max(found) <= 700 * 5
    got = defaultdict(list)
    for q, c, s in zip(*near.rows_found()):
        got[int(q)].append((-float(s), int(c)))
    assert dict(got) == {q: sorted((-float(x[q] @ y[i]), int(ids[i])) for i in np.flatnonzero(np.isin(leaf, ways[q])))[:5] for q in range(700)}
