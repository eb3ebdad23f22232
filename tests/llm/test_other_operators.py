import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tablehealth.llm import catalogue, common, encode, licences, mixing, topk, toxicity
from tests.llm import brute


def test_targets_share_everything_within_their_limits(spark):
    cases = [([100, 100, 100], [5, 2, 1]), ([10, 100, 100], [5, 2, 1]), ([0, 5], [5, 2]), ([1, 2, 3, 4, 5, 600, 700], [5, 2, 1, 5, 2, 1, 5]), ([0, 0], [5, 2])]
    for sizes, weights in cases:
        table = spark.createDataFrame(list(zip(range(len(sizes)), sizes, weights, strict=True)), "i long, source_size long, weight int")
        found = [r.target for r in mixing.targets(table).orderBy("i").collect()]
        assert found == pytest.approx(brute.targets(sizes, weights))
        assert sum(found) == pytest.approx(sum(sizes)) and all(t <= 3 * s for t, s in zip(found, sizes, strict=True))
    assert mixing.targets(spark.createDataFrame([], "source_size long, weight int")).count() == 0


@pytest.mark.parametrize("broadcast", [True, False])
def test_schedule_ranks_and_shares(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    shares, low = [5, 0, 2, 1], 0
    rows = []
    for i, x in enumerate(shares):
        rows.append((i, low, low := low + x * 5000 * mixing.DUE_UNIT))
    found = mixing.schedule(spark.createDataFrame(rows, "_source long, _low long, _high long")).collect()
    assert sorted(r.slot for r in found) == list(range(40_000))
    by = {}
    for r in sorted(found, key=lambda r: r.slot):
        assert r.rank == by.get(r._source, 0)
        by[r._source] = r.rank + 1
    assert 1 not in by
    for i, share in enumerate(shares):
        assert by.get(i, 0) == pytest.approx(40_000 * share / 8, abs=20)


def test_sources_are_numbered_by_code_point_nulls_last(spark):
    names = ["b", "a", "é", "Z", "\U0001d518", "\uffff", "", None, "ab"]
    sized = spark.createDataFrame([(n, 10) for n in names for _ in range(3)], "source string, size long").repartition(4)
    found = [r.source for r in mixing.sources_of(sized).orderBy("_source").collect()]
    assert found == sorted((n for n in names if n is not None), key=lambda n: [ord(c) for c in n]) + [None]


def test_many_small_sources_come_near_their_targets(spark):
    """200 sources of 160 words beside one of 18,000, at the block size of the query."""
    rows = [(i, " ".join(["w"] * 160), f"s{i:03}") for i in range(200)] + [(1000 + i, " ".join(["w"] * 600), "t") for i in range(30)]
    found = mixing.taken(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    taken, goal = {}, {}
    for r in found:
        s = r.doc_id if r.doc_id < 1000 else "t"
        taken[s], goal[s] = taken.get(s, 0) + r.taken, r.target
        assert r.taken <= 3 * r.size
    assert sum(taken.values()) == pytest.approx(50_000, rel=0.01)
    assert all(taken[s] > 0 for s in goal)
    assert all(taken[s] == pytest.approx(goal[s], rel=0.1) for s in goal)


def test_copies_that_are_a_third_of_all_rows(spark):
    rows = [(7, "one and the same text of nine words here", "a")] * 400 + [(i, f"other text number {i} with a few words", "ab"[i % 2]) for i in range(1000, 1800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = [mixing.taken(d).collect() for d in (docs.repartition(3), docs.repartition(5))]
    assert brute.order(map(tuple, found[0])) == brute.order(map(tuple, found[1])) and len(found[0]) == len(rows)
    assert all(r.taken <= 3 * r.size for r in found[0])


def test_mix_meets_targets_and_limits(docs, edges):
    found = mixing.taken(docs, 4).collect()
    sizes = {}
    for _, t, _, s, *_ in edges:
        sizes[s] = sizes.get(s, 0) + len(brute.WORD.findall(t or ""))
    names = sorted((s for s in sizes if s is not None)) + [None]
    goals = dict(zip(names, brute.targets([sizes[s] for s in names], [float((5, 2, 1)[i % 3]) for i in range(len(names))]), strict=True))
    source = {(d, len(brute.WORD.findall(t or ""))): s for d, t, _, s, *_ in edges}
    taken = {}
    assert len(found) == len(edges)
    for r in found:
        s = source[r.doc_id, r.size]
        assert r.taken <= 3 * r.size and r.source_size == sizes[s] and r.target == pytest.approx(goals[s])
        taken[s] = taken.get(s, 0) + r.taken
    for s, goal in goals.items():
        assert taken[s] == pytest.approx(goal, abs=60)
    again = mixing.taken(docs.repartition(5), 4).collect()
    assert brute.order(map(tuple, again)) == brute.order(map(tuple, found))


def test_taken_words_equal_a_walk_over_all_slots(docs):
    """Slot by slot and block by block in plain Python, from the sources and the documents' places in them."""
    with common.scratch(docs.sparkSession):
        sized, placed, sources = mixing.prepare(docs)
        rows = {r["_row"]: (r["doc_id"], r["_doc"], r["_key"]) for r in sized.collect()}
        places = [(r["_row"], r["_source"], r["_at"], r["size"]) for r in placed.collect()]
        known = {r["_source"]: (r["source_size"], r["blocks"], r["_low"], r["_high"]) for r in sources.collect() if r["blocks"]}
    for source, (size, *_) in known.items():  # documents lie side by side in their source
        own = sorted((at, n) for _, s, at, n in places if s == source)
        assert [at for at, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) == size
    words = brute.mixed(known, places, int(mixing._PHI), mixing.DUE_UNIT)
    expected = brute.order((*identity, words[row]) for row, identity in rows.items())
    assert brute.order((r["doc_id"], r["_doc"], r["_key"], r["taken"]) for r in mixing.taken(docs).collect()) == expected


@pytest.mark.parametrize(("small", "target"), [(20, 60), (40, 120), (130, 390)])
def test_small_source_beside_large_ones_gets_its_target(spark, small, target):
    rows = [(i, " ".join(["w"] * 500), s) for s in ("b", "c") for i in range(40)] + [(99, " ".join(["v"] * small), "a")]
    found = mixing.taken(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    assert [(r.target, r.taken) for r in found if r.doc_id == 99] == [(target, target)]
    assert sum(r.taken for r in found) == pytest.approx(40_000 + small, abs=256)


def test_long_tail_of_small_sources_shares_all_words(spark):
    sizes = [20 + 37 * i % 241 for i in range(600)]
    docs = spark.createDataFrame([(i, " ".join(["w"] * n), f"s{i:03}") for i, n in enumerate(sizes)], "doc_id long, text string, source string")
    found = mixing.taken(docs).collect()
    assert sum(r.taken for r in found) == pytest.approx(sum(sizes), rel=0.02)
    at_limit = [r for r in found if r.target >= 3 * r.source_size]
    assert at_limit and all(r.taken == 3 * r.size for r in at_limit)
    assert all(abs(r.taken - r.target) < 2 * 128 for r in found)


def test_blocks_of_a_source_are_of_equal_length(spark):
    docs = spark.createDataFrame([(i, " ".join(["w"] * n), "ab"[i % 2]) for i, n in enumerate((7, 130, 1, 400, 0, 129, 33))], "doc_id long, text string, source string")
    sized, placed, sources = mixing.prepare(docs)
    rows = mixing.parts(placed.withColumn("_used", F.col("blocks"))).join(sized.select("_row", "doc_id"), "_row").collect()
    for s in sources.collect():
        words = {}
        for r in rows:
            if r._source == s["_source"]:
                words[r._block] = words.get(r._block, 0) + r.n_words
        assert sorted(words) == list(range(s["blocks"])) and sum(words.values()) == s["source_size"]
        assert max(words.values()) <= 128 and max(words.values()) - min(words.values()) <= 1
    for d in sized.collect():
        spans = sorted((r.word_start, r.n_words) for r in rows if r.doc_id == d.doc_id)
        assert [a for a, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))] and sum(n for _, n in spans) == d.size


def test_mix_as_documents(docs, nothing):
    out = mixing.repeat(docs, 4)
    assert out.columns == docs.columns
    assert all(r.text and r.text.strip() for r in out.collect())
    assert mixing.repeat(nothing).count() == 0 and mixing.taken(nothing).count() == 0


def test_mix_as_documents_keeps_the_words_of_a_source(spark):
    sizes = {"a": [40] * 20, "b": [9000, 30, 50], "c": [7000, 7000, 1, 90]}
    rows = [(100 * k + i, "  ".join(f"{s}{j}\n" for j in range(n)), s, 0) for k, (s, ns) in enumerate(sizes.items()) for i, n in enumerate(ns)]
    rows += rows[-1:] * 2  # copies of a row share its words
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    texts = {r[0]: r[1] for r in rows}
    goals, words = {}, {}
    for r in mixing.taken(docs).collect():
        s = "abc"[r.doc_id // 100]
        goals[s] = goals.get(s, 0) + r.taken
    for r in mixing.repeat(docs).collect():
        words[r.source] = words.get(r.source, 0) + len(brute.WORD.findall(r.text))
        assert texts[r.doc_id].startswith(r.text) and (r.text == texts[r.doc_id] or r.n_chars == len(r.text))
    assert min(goals.values()) > 0
    for s, goal in goals.items():
        assert words[s] == pytest.approx(goal, abs=3)


def vectors():
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).round(3).tolist()) for i in range(300)]
    rows += [(i, [0.5] * 6) for i in range(300, 420)]  # one vector over and over: ties
    rows += [(420, None), (450, []), (500, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (550, [math.nan] * 6), (600, [math.inf] + [0.0] * 5), (650, [0.1, 0.2]), (651, [0.3, -0.2]), (700, [1e5] * 6), (50, [0.25] * 6)]
    return rows


def expected_top(rows, k=5, every=50):
    sound = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in sound]
    out = set()
    for qi, q in whole:
        if qi % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), i) for i, v in whole if i != qi and len(v) == len(q))
            out |= {(qi, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)}
    return out


@pytest.mark.parametrize("shard_rows", [40, topk.SHARD_ROWS])
def test_top_k_equals_brute_force(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard_rows)
    rows = [r for r in vectors() if r != (50, [0.25] * 6)]
    table = spark.createDataFrame([(i, v, 9) for i, v in rows], "vec_id long, embedding array<float>, score int")
    assert {tuple(r) for r in topk.top_k(table).collect()} == expected_top(rows)


def expected_top_of_repeated(rows, k=5, every=50):
    """As the SQL has it: the rows of one id are one query, each with a score of its own for every other row."""
    sound = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in sound]
    scores = {}
    for qi, q in whole:
        if qi % every == 0:
            scores.setdefault(qi, []).extend((-sum(a * b for a, b in zip(q, v, strict=True)), i) for i, v in whole if i != qi and len(v) == len(q))
    return sorted((qi, n, i, -s) for qi, found in scores.items() for n, (s, i) in enumerate(sorted(found)[:k], 1))


@pytest.mark.parametrize("shard_rows", [40, topk.SHARD_ROWS])
@pytest.mark.parametrize("copies", [1, 6, 7, 70])
def test_top_k_of_repeated_ids(spark, monkeypatch, shard_rows, copies):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard_rows)
    rows = vectors() + [(100, [9.0] * 6), (200, [-3.0, 2.0, 0.5, 0.0, 1.0, -8.0])] * copies
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in topk.top_k(table).collect()) == expected_top_of_repeated(rows)


def test_shards_are_bounded_when_an_id_repeats(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    sizes, deal = [], topk.deal

    def counted(*given):
        dealt = deal(*given)
        sizes.extend(r["count"] for r in dealt.groupBy("_shard").count().collect())
        return dealt

    monkeypatch.setattr(topk, "deal", counted)
    rows = [(3, [1.0, float(i % 20)]) for i in range(400)] + [(50, [1.0, 2.0])] * 100
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted(tuple(r) for r in found) == expected_top_of_repeated(rows)
    assert sum(sizes) == 500 and max(sizes) <= 80


def test_queries_go_only_to_shards_within_reach(spark, monkeypatch):
    """Far groups of vectors: the k-th score of the first shard shuts the others out."""
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(topk, "TASK_QUERIES", 8)
    rng = np.random.default_rng(8)
    rows = [(50 * i if i % 5 == 0 else 50 * i + 1, (rng.normal(size=3) * 0.1 + 10 * np.eye(3)[i % 3]).tolist()) for i in range(600)]
    asked, search = [], topk.search
    monkeypatch.setattr(topk, "search", lambda dealt, queries, pairs, k: asked.append((queries.count(), queries.select("_part").distinct().count(), pairs.count(), dealt.select("_shard").distinct().count())) or search(dealt, queries, pairs, k))
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted(tuple(r) for r in found) == expected_top_of_repeated(rows)
    (n, _, home, shards), (again, parts, others, _) = asked
    # what is stored: a row for each query, and one for each part and shard that meet
    assert n == again == 120 and shards >= 12 and parts >= 3 and home <= 120
    assert others < parts * (shards - 1)


def test_top_k_of_one_leaf_with_copies(spark):
    rows = [(0, [5.0, 5.0])] * 6 + [(i, [i / 10, 1.0]) for i in range(1, 20)]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted(tuple(r) for r in found) == expected_top_of_repeated(rows) and len(found) == 5


def test_top_k_of_nothing_and_of_few(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(none).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [3.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(few).orderBy("rank").collect()] == [(0, 1, 2, 256 * 768), (0, 2, 1, 256 * 512)]


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(900):
        toxic = i % 4 == 0
        text = [rng.choice(words) for _ in range(40)]
        if toxic:
            for _ in range(3):
                text[rng.randrange(40)] = rng.choice(["nastyword", "vileword"])
        docs.append((i, " ".join(text), "en", "s"))
        labels.append((i, 0, int(toxic)))
    docs += [(2000, None, None, None), (2001, "", None, None), (None, "vileword", None, None), (3, docs[3][1], "en", "s")]
    labels += [(3, 0, None), (None, 0, 1), (5000, 0, 1)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = toxicity.classify(table, marks).collect()
    assert len(found) == len(docs)
    right = 0
    for r in found:
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.doc_id is not None and r.doc_id < 900 and r.held_out:
            right += r.predicted == int(r.doc_id % 4 == 0)
    held = sum(r.held_out and r.doc_id is not None and r.doc_id < 900 for r in found)
    assert right / held > 0.95
    assert len({r.score for r in found if r.doc_id in (2000, 2001)}) == 1


def test_ftrl_equals_a_plain_one():
    """Coordinate by coordinate, in plain Python."""
    rng = np.random.default_rng(2)
    rows = [(np.append(np.unique(rng.integers(0, 40, rng.integers(1, 12))), 40), int(rng.random() < 0.4)) for _ in range(400)]
    z, n = np.zeros(41), np.zeros(41)
    toxicity.train(z, n, rows)
    plain_z, plain_n = [0.0] * 41, [0.0] * 41
    for at, label in rows:
        w = {}
        for i in at.tolist():
            rate = (toxicity.BETA + math.sqrt(plain_n[i])) / toxicity.ALPHA + toxicity.L2
            l1 = 0.0 if i == 40 else toxicity.L1
            w[i] = 0.0 if abs(plain_z[i]) <= l1 else -(plain_z[i] - math.copysign(l1, plain_z[i])) / rate
        g = 1 / (1 + math.exp(-sum(w.values()))) - label
        for i in w:
            sigma = (math.sqrt(plain_n[i] + g * g) - math.sqrt(plain_n[i])) / toxicity.ALPHA
            plain_z[i] += g - sigma * w[i]
            plain_n[i] += g * g
    assert z == pytest.approx(plain_z, abs=1e-9) and n == pytest.approx(plain_n, abs=1e-9)


def test_toxicity_of_awkward_tables(spark):
    """Rows of one id in any order give one model; columns may clash; a very long text is scored whole."""
    rng = random.Random(5)
    rows = [(i // 2, " ".join(rng.choice(["vileword", "good", "plain", "talk", f"w{rng.randrange(30)}"]) for _ in range(12)), "s", 1, b"x", 0.5) for i in range(300)]
    rows.append((900, "good " * 200_000 + "vileword " * 50, "s", 1, b"x", 0.5))
    marks = spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i in range(150)], "doc_id long, quality int, toxic int")
    schema = "doc_id long, text string, shard string, label int, features binary, score double"
    found = []
    for order in (rows, rows[::-1]):
        scored = toxicity.classify(spark.createDataFrame(order, schema).repartition(3), marks).collect()
        found.append(sorted((r.doc_id, r.score, r.predicted, r.held_out) for r in scored))
    assert found[0] == found[1] and len(found[0]) == 301


def test_toxicity_without_labels(spark, docs, nothing):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.predicted == 0 for r in toxicity.classify(docs, marks).collect())
    assert toxicity.classify(nothing, marks).count() == 0


LICENCES = [
    (1, "Some words. Released under the MIT License."),
    (2, "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file\nexcept in compliance with the License. More."),
    (3, "Permission is hereby granted. The end."),
    (4, "A: Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Other words! Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    (30, "no full stop here\nReleased under the MIT License.\nand on"), (5, None), (6, ""), (7, "licence license"), (8, "LICENSED UNDER CC BY-NC 4.0.\n\nlicensed under cc by 4.0"), (8, "LICENSED UNDER CC BY-NC 4.0.\n\nlicensed under cc by 4.0"), (None, "This work is licensed under the GNU General Public License, version 3."),
]


def test_licences(spark, nothing):
    docs = spark.createDataFrame([(d, t, "x") for d, t in LICENCES], "doc_id long, text string, licences string")
    found = brute.order(tuple(r) for r in licences.scan(docs).collect())
    by = {r[0]: r[3] for r in found}
    assert by == {1: "MIT", 2: "Apache-2.0", 3: "", 4: "BSD-2-Clause", 5: "", 6: "", 7: "", 30: "MIT", 8: "CC-BY-4.0,CC-BY-NC-4.0", None: "GPL-3.0-only"}
    assert licences.scan(nothing).count() == 0
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", LICENCES)
    assert brute.order(con.sql(licences.duckdb_sql()).fetchall()) == found


OFFICIAL = {
    "MIT": """MIT License

Copyright (c) 2020 A. Holder

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
AUTHORS BE LIABLE FOR ANY CLAIM.""",
    "Apache-2.0": """Copyright 2020 A. Holder

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS.""",
    "GPL-3.0-or-later": """Copyright (C) 2020 A. Holder

This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.""",
    "BSD-2-Clause": """Copyright (c) 2020, A. Holder
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS".""",
    "ISC": """Copyright 2020 A. Holder

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "GPL-3.0-only": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0": "This photo: Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC0-1.0": """To the extent possible under law, the author has waived all copyright and
related or neighboring rights to this work.""",
}
OFFICIAL["BSD-3-Clause"] = OFFICIAL["BSD-2-Clause"].replace("THIS SOFTWARE", """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE""")


OFFICIAL["BSD-4-Clause"] = OFFICIAL["BSD-2-Clause"].replace("THIS SOFTWARE", """3. All advertising materials mentioning features or use of this software must
   display the following acknowledgement:
   This product includes software developed by the organization.

4. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE""")
_GNU = """This {what} is free software{mark} you can redistribute it and/or
modify it under the terms of the GNU {name} Public
License as published by the Free Software Foundation{join} either
version {version} of the License, or (at your option) any later version.

This {what} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
OFFICIAL |= {
    "GPL-2.0-only": """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License version 2 as
published by the Free Software Foundation.""",
    "GPL-2.0-or-later": _GNU.format(what="program", mark=";", name="General", join=";", version="2"),
    "LGPL-2.1-or-later": _GNU.format(what="library", mark=";", name="Lesser General", join=";", version="2.1"),
    "LGPL-3.0-or-later": _GNU.format(what="library", mark=":", name="Lesser General", join=",", version="3"),
    "AGPL-3.0-or-later": _GNU.format(what="program", mark=":", name="Affero General", join=",", version="3"),
    "Artistic-1.0-Perl": "This library is free software; you can redistribute it and/or modify it\nunder the same terms as Perl itself.",
    "EPL-1.0": """All rights reserved. This program and the accompanying materials
are made available under the terms of the Eclipse Public License v1.0
which accompanies this distribution, and is available at
http://www.eclipse.org/legal/epl-v10.html""",
    "EPL-2.0": """This program and the accompanying materials are made
available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/""",
    "MPL-1.1": """The contents of this file are subject to the Mozilla Public License Version
1.1 (the "License"); you may not use this file except in compliance with
the License.""",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "BSL-1.0": "         Distributed under the Boost Software License, Version 1.0.\n   (See accompanying file LICENSE_1_0.txt)",
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.""",
    "PostgreSQL": """Permission to use, copy, modify, and distribute this software and its
documentation for any purpose, without fee, and without a written agreement is
hereby granted, provided that the above copyright notice and this paragraph
and the following two paragraphs appear in all copies.""",
    "WTFPL": """Everyone is permitted to copy and distribute verbatim or modified
copies of this license document, and changing it is allowed as long
as the name is changed.""",
    "MIT-0": OFFICIAL["MIT"].replace(", subject to the following conditions:", ".").replace("""The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

""", ""),
}
OFFICIAL["LGPL-2.0-or-later"] = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Library General Public
License as published by the Free Software Foundation; either
version 2 of the License, or (at your option) any later version."""
OFFICIAL["LGPL-2.1-only"] = """                  GNU LESSER GENERAL PUBLIC LICENSE
                       Version 2.1, February 1999

 Copyright (C) 1991, 1999 Free Software Foundation, Inc."""
OFFICIAL["LGPL-3.0-only"] = """                   GNU LESSER GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007"""
OFFICIAL["AGPL-3.0-only"] = """                    GNU AFFERO GENERAL PUBLIC LICENSE
                       Version 3, 19 November 2007"""
for _name, _said in (("CC-BY-NC-SA-4.0", "Attribution-NonCommercial-ShareAlike 4.0 International"), ("CC-BY-ND-4.0", "Attribution-NoDerivatives 4.0 International"), ("CC-BY-NC-ND-4.0", "Attribution-NonCommercial-NoDerivatives 4.0 International"), ("CC-BY-3.0", "Attribution 3.0 Unported"), ("CC-BY-SA-3.0", "Attribution-ShareAlike 3.0 Unported")):
    OFFICIAL[_name] = f"This work is licensed under a Creative Commons {_said} License."


def test_official_licence_texts(spark):
    assert set(OFFICIAL) == set(licences.RULES) - set(licences.SPDX)
    rows, expected = [], {}
    for mark in ("", "# ", " * ", "// ", "-- "):
        for name, text in OFFICIAL.items():
            expected[len(rows)] = name
            rows.append((len(rows), "\n".join((mark + line).rstrip() for line in text.split("\n"))))
    more = [
        (OFFICIAL["GPL-3.0-or-later"].replace("software: you", "software; you"), "GPL-3.0-or-later"),
        ("This program is free software; it costs nothing.", ""),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "MPL-2.0"),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 3.0.", ""),
        (" * This Source Code Form is subject to the terms of the Mozilla Public License, v.\n * 2.0. If", "MPL-2.0"),
        ("See section v. Released under the MIT License. v. 2.0. Licensed under CC BY 4.0.", "MIT,CC-BY-4.0"),
        ("See the code.\nYou may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0.", "Apache-2.0"),
    ]
    more += [(f"// SPDX-License-Identifier: {name}\nint x;", name) for name in licences.RULES]
    # another licence's sentence between those of one
    more.append((OFFICIAL["BSD-2-Clause"].replace("2. Redis", "Licensed under CC BY 4.0.\n\n2. Redis"), "BSD-2-Clause,CC-BY-4.0"))
    for text, name in more:
        expected[len(rows)] = name
        rows.append((len(rows), text))
    found = [tuple(r) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert {r[0]: r[3] for r in found} == expected
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert brute.order(con.sql(licences.duckdb_sql()).fetchall()) == brute.order(found)


_B = OFFICIAL["BSD-3-Clause"]
# wording as it is found in the wild, with what it means
WILD = [
    (_B.replace("the copyright holder nor","Google Inc. nor"),"BSD-3-Clause"),
    (_B.replace("the copyright holder nor","the University nor"),"BSD-3-Clause"),
    (_B.replace("nor the names of its\n   contributors may be used to endorse","or anybody else may be used to endorse"),""),
    ("/* This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License version 2 as\n * published by the Free Software Foundation.\n */","GPL-2.0-only"),
    ("This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; version 2 of the License.","GPL-2.0-only"),
    ("This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Library General Public\nLicense as published by the Free Software Foundation; either\nversion 2 of the License, or (at your option) any later version.","LGPL-2.0-or-later"),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.","GPL-3.0-only"),
    ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS","Apache-2.0"),
    (OFFICIAL["MIT"].replace("A. Holder\n\nPerm","A. Holder\nPerm"),"MIT"),
    (OFFICIAL["MIT"].replace("Copyright (c) 2020 A. Holder\n\nPerm","Copyright (c) 2020 The Holders\nPerm"),"MIT"),
    ("Licensed under the MIT License.","MIT"),
    ("// SPDX-License-Identifier: Apache-2.0 OR MIT","MIT,Apache-2.0"),
    ("/* SPDX-License-Identifier: (GPL-2.0-only OR MIT) */","MIT,GPL-2.0-only"),
    ("# SPDX-License-Identifier: GPL-2.0","GPL-2.0-only"),
    ("# SPDX-License-Identifier: GPL-2.0+\nfoo","GPL-2.0-or-later"),
    ("x\n// SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0","GPL-2.0-or-later"),
    (None,""),
    ("",""),
    ("                                 Apache License\n                           Version 2.0, January 2004\n\n","Apache-2.0"),
]


def test_licences_in_the_wild(spark):
    rows = [(i, text) for i, (text, _) in enumerate(WILD)] + [(len(WILD), "word. " * 60_000 + OFFICIAL["MIT"])]  # and a very long text
    found = [tuple(r) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert {r[0]: r[3] for r in found} == {i: said for i, (_, said) in enumerate([*WILD, ("", "MIT")])}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert brute.order(con.sql(licences.duckdb_sql()).fetchall()) == brute.order(found)


def test_licence_scan_is_native(spark, docs):
    plan = licences.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange hash" not in plan


def test_oracle_sql_agrees(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, sql in catalogue.oracle_sql().items():
        df = catalogue.queries()[name](spark, sf_dir)
        expected = con.sql(sql)
        order = [expected.columns.index(c) for c in df.columns]
        assert brute.order(tuple(r) for r in df.collect()) == brute.order(tuple(r[i] for i in order) for r in expected.fetchall()), name


def _words(text):
    return [w.decode() for w in (text or "").encode().split()]


def _check_stage(name, before, after, columns):
    """A stage's output against plain versions over its own input."""
    pairs = [(r.doc_id, r.text) for r in before]
    last = lambda d: float("inf") if d is None else d
    if name == "quality_rules":
        base = [brute.quality(t) for _, t in pairs]
        failed = [b[0] < 10 or 100 * b[4] > 20 * b[0] for b in base]
        kept = brute.verdicts([(r.source, f) for r, f in zip(before, failed, strict=True)])
        assert brute.order(map(tuple, after)) == brute.order(tuple(r) for r, k in zip(before, kept, strict=True) if k)
    elif name == "jaccard_join":
        groups = {}
        for i, group in enumerate(brute.jaccard(pairs, groups=True)):
            groups.setdefault(group, []).append((last(pairs[i][0]), i))
        assert sorted(last(r.doc_id) for r in after) == sorted(min(g)[0] for g in groups.values())
        assert {tuple(r) for r in after} <= {tuple(r) for r in before}
    elif name == "substring_dedup":
        expected = brute.order((d, sha) for d, n, gone, sha in brute.word_repeats(pairs) if n > gone)
        assert brute.order((r.doc_id, hashlib.sha256(" ".join(_words(r.text)).encode()).hexdigest()) for r in after) == expected
        assert all(r.n_chars == len(r.text) for r in after)
    elif name == "source_mix":
        size, got = {}, {}
        for r in before:
            size[r.source] = size.get(r.source, 0) + len(_words(r.text))
        for r in after:
            got[r.source] = got.get(r.source, 0) + len(_words(r.text))
        names = sorted((s for s in size), key=lambda s: (s is None, s or ""))
        due = brute.targets([size[s] for s in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))])
        for s, target in zip(names, due, strict=True):
            assert abs(got.get(s, 0) - target) <= max(0.05 * target, 260), (s, got.get(s, 0), target)
    else:
        encoder = encode.encoder(encode.vocabulary_path("byte_bpe_50k.json"))
        assert sum(r.length for r in after) == sum(len(encoder.encode_many([t])[0]) + 1 for _, t in pairs)
        filled = {}
        for r in sorted(after, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == filled.get(r.sequence_id, 0)
            filled[r.sequence_id] = r.offset + r.length
        assert max(filled.values(), default=0) <= 1024
    if name != "best_fit_packing":
        assert columns[0] == columns[1]


@pytest.mark.parametrize("table", ["given", "awkward", "empty"])
def test_pipeline(spark, sf_dir, docs, nothing, table):
    import corpus_pipeline

    frame = {"given": lambda: common.documents(spark, sf_dir), "awkward": lambda: docs, "empty": lambda: nothing}[table]()
    for name, function in corpus_pipeline.STAGES:
        found = common.stage(function(spark, frame, sf_dir), name)
        _check_stage(name, frame.collect(), found.collect(), (frame.columns, found.columns))
        frame = found


def test_pipeline_leaves_its_result_alone_behind(spark, sf_dir, tmp_path, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert len(list(tmp_path.iterdir())) == 1


def test_thin_keeps_every_row_with_a_partner_and_few_others(spark):
    rows = spark.range(200_000).withColumn("more", F.col("id") % 7)
    keys = common.stage(spark.range(0, 200_000, 40).withColumn("more", F.col("id") % 7), "thin-keys")
    kept = common.thin(rows, keys, ["id", "more"])
    assert kept.join(keys, ["id", "more"], "left_semi").count() == 5_000
    assert kept.count() < 5_000 + 195_000 * 0.05
    none = common.stage(keys.limit(0), "thin-none")
    assert common.thin(rows, none, ["id", "more"]).count() == 0


def test_thin_goes_without_a_bitmap_that_would_be_half_full(spark, monkeypatch):
    monkeypatch.setattr(common, "FILTER_BYTES", 1 << 12)
    keys = common.stage(spark.range(20_000), "thin-many")
    assert common.thin(spark.range(50_000), keys, ["id"]).count() == 50_000
