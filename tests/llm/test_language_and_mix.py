"""Language identification, mixing, vector search and licences."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import declarium.llm.mixture as mixture
from declarium.llm import language_id, license_scan, vector_search
from declarium.llm.common import table
from declarium.llm.language_id import Identifier, gram_text, ngrams


def brute_grams(text):
    found = Counter()
    word = ""
    for char in text.lower() + " ":
        if char.isalpha():
            word += char
            continue
        padded = f" {word} "
        for n in (1, 2, 3):
            found.update(g for g in (padded[i : i + n] for i in range(len(padded) - n + 1)) if word and g != " ")
        word = ""
    return found


@pytest.mark.parametrize("text", ["The cat, the CAT.", "a b  c", "é1ß_中文", "x" * 5000])
def test_ngrams(text):
    grams, counts = ngrams(text)
    assert {gram_text(g): n for g, n in zip(grams.tolist(), counts.tolist())} == brute_grams(text)


def test_distance_by_hand():
    profiles = {"a": ngrams("abab")[0].tolist(), "b": ngrams("cdcd")[0].tolist()}
    lang, score = Identifier(profiles).predict("ab")
    assert lang == "a" and 0 < score <= 1
    assert Identifier({}).predict("ab") == ("und", 0.0)
    assert Identifier({"z": [1], "a": [1]}).predict("ab")[0] == "a"


def test_language_of_held_out_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    langs = {r.doc_id: r.lang for r in docs.collect()}
    found = language_id.language_id(docs).collect()
    assert len(found) == len(langs)
    for row in found:
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 5 == 0)
    held = [r for r in found if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.98


def test_odd_texts(make_docs):
    rows = [(i, f"the cat and the dog number {i}", "en") for i in range(20)]
    rows += [(i, f"der hund und die katze {i}", "de") for i in range(20, 40)]
    odd = [(100, None, "en"), (101, "", None), (102, "123 !?", "de"), (None, "the dog", "en"), (103, "the dog " * 9000)]
    docs = make_docs(rows + odd, extra=True)
    found = {r.doc_id: r for r in language_id.language_id(docs).collect()}
    assert [found[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3
    assert found[None].lang_pred == "en" and found[None].held_out
    assert found[103].lang_pred == "en"
    kept = language_id.keep_identified(docs, language_id.learn_profiles(docs))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {*range(40), None, 103}
    assert language_id.language_id(make_docs([])).count() == 0


UNLEARNED = [
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni "
    "obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on "
    "annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana "
    "sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах.",
]


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_only_learned_languages_are_kept(spark, make_docs, folder):
    """Noise and texts of other languages go, every clean document stays."""
    docs = table(spark, folder, "documents")
    profiles = language_id.learn_profiles(docs)
    floors = language_id.learn_floors(docs, profiles)
    assert floors.keys() == profiles.keys()
    assert floors == language_id.learn_floors(docs.repartition(5), profiles)
    kept = language_id.keep_identified(docs, profiles)
    assert kept.count() == docs.count()
    chance = np.random.default_rng(6)
    small = list("abcdefghijklmnopqrstuvwxyz    ")
    signs = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
    noise = ["".join(chance.choice(s, 2_000)) for s in (small, signs) for _ in range(3)]
    odd = make_docs([(i, text, "en") for i, text in enumerate(noise + UNLEARNED)])
    assert language_id.keep_identified(odd, profiles, floors).count() == 0


def dealt_one_by_one(weights, seats, most):
    dealt = np.zeros(len(weights), int)
    for _ in range(int(min(seats, most[weights > 0].sum()))):
        dealt[np.where((dealt < most) & (weights > 0), weights / (2 * dealt + 1), -1).argmax()] += 1
    return dealt


def test_apportionment(spark):
    """Two hundred groups at once, against dealing seat by seat."""
    chance = np.random.default_rng(1)
    rows, expected = [], {}
    for case in range(200):
        n = int(chance.integers(1, 7))
        weights = chance.choice([0, 1, 2, 3.5, 10, 1e6, 1e-6], n).astype(float)
        most, seats = chance.integers(0, 12, n), int(chance.integers(0, 30))
        rows += [(case, i, float(w), int(m), seats) for i, (w, m) in enumerate(zip(weights, most))]
        expected[case] = dealt_one_by_one(weights, seats, most).tolist()
    df = spark.createDataFrame(rows, "g long, i long, weight double, most long, seats long")
    for at_once in (0, 100):  # by aggregations, and each group in a task
        found: dict = {}
        for r in mixture.apportion(df, "g", "i", at_once).orderBy("g", "i").collect():
            found.setdefault(r.g, []).append(r.given)
        assert found == expected


def filled(sizes, weights, most=3):
    """Targets by raising the level a little at a time, in exact steps from limit to limit."""
    limits, left = [most * s for s in sizes], sum(sizes)
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        level = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if level * weights[i] > limits[i]}
        if not full:
            return [out[i] if i not in open_ else level * weights[i] for i in range(len(sizes))]
        for i in full:
            out[i], left = float(limits[i]), left - limits[i]
        open_ -= full
    return out


def test_targets_share_the_excess(spark):
    chance = np.random.default_rng(2)
    cases = [([10, 1000, 1000], [3, 1, 2])]
    cases += [((10 ** chance.integers(0, 6, 9)).tolist(), chance.integers(1, 4, 9).tolist()) for _ in range(5)]
    for sizes, weights in cases:
        df = spark.createDataFrame(
            [(s, float(w), 3.0 * s) for s, w in zip(sizes, weights)], "words long, weight double, limit double"
        )
        level = mixture.target_level(df)
        assert np.allclose([min(level * w, 3 * s) for s, w in zip(sizes, weights)], filled(sizes, weights))
    assert mixture.target_level(df.limit(0)) == 0.0


def test_as_many_sources_as_documents(spark, monkeypatch):
    """Every document a source of its own, in thousands; the driver keeps none of them."""
    monkeypatch.setattr(mixture.apportion, "__defaults__", (1000,))
    docs = spark.range(30_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("host"), F.lpad("id", 6, "0")).alias("source"),
        F.repeat(F.lit("w "), (F.col("id") % 50).cast("int")).alias("text"),
    )
    found = mixture.mixture(docs).collect()
    sizes = [r.size for r in sorted(found, key=lambda r: r.doc_id)]
    assert sizes == [i % 50 for i in range(30_000)]
    goal = filled(sizes, [1 + i % 3 for i in range(30_000)])
    assert np.allclose([r.target for r in sorted(found, key=lambda r: r.doc_id)], goal)
    assert all(0 <= r.taken <= 3 * r.size for r in found)
    assert abs(sum(r.taken for r in found) - sum(goal)) < 0.01 * sum(goal)


@pytest.mark.parametrize("shard_docs", [4096, 25])
def test_mix(spark, shard_docs):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    found = mixture.mixture(docs, shard_docs=shard_docs).collect()
    texts = {r.doc_id: (r.source, len((r.text or "").encode().split())) for r in docs.collect()}
    assert len(found) == len(texts)
    names = sorted({s for s, _ in texts.values()})
    sizes = np.array([sum(n for s, n in texts.values() if s == name) for name in names])
    goal = dict(zip(names, filled(sizes.tolist(), np.resize([1.0, 2.0, 3.0], len(names)).tolist())))
    taken = Counter()
    for r in found:
        source, size = texts[r.doc_id]
        assert r.size == size and np.isclose(r.target, goal[source])
        assert 0 <= r.taken <= 3 * size
        taken[source] += r.taken
    for name in names:
        assert abs(taken[name] - goal[name]) < 0.02 * goal[name] + 100
    again = mixture.mixture(docs.repartition(7), shard_docs=shard_docs).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))


def test_whole_rows_are_shuffled_once(spark, make_docs):
    """Quotas are sent to the rows, and rows meet by shard alone."""
    import re

    docs = make_docs([(i, f"word {i} " * 9, "en", f"s{i % 5}") for i in range(300)])
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        mixed = mixture.mix_documents(docs)
        plan = mixed._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    above = re.findall(r"Exchange hashpartitioning.*\n.*Project \[.*\brow#", plan)
    assert len(above) == 1 and "_number" in above[0] and "_shard" in above[0]


def test_mix_of_odd_rows(make_docs):
    rows = [
        (1, "a b c", "x", None), (2, None, "x", "s"), (3, "", "x", "s"), (4, "w " * 500, "x", "s"),
        (4, "w " * 500, "x", "s"), (None, "k l", "x", "t"), (5, " \t\n", "x", "empty"),
    ]
    docs = make_docs(rows)
    found = sorted(map(tuple, mixture.mixture(docs).collect()), key=repr)
    assert len(found) == len(rows)
    assert all(t <= 3 * size for _, size, _, _, t in found)
    assert sum(t for *_, t in found) <= 3 * 1005
    kept = mixture.mix_documents(docs.withColumn("taken", docs["doc_id"]))
    assert kept.columns == [*docs.columns, "taken"]
    assert mixture.mixture(make_docs([])).count() == 0
    assert mixture.mix_documents(make_docs([])).count() == 0


def brute_top(rows, k=5):
    kept = [
        (i, tuple(np.floor(256 * np.array(v, float)).astype(int)))
        for i, v in rows
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for query in {i for i, _ in kept if i % 50 == 0}:
        scored = sorted(
            (-int(np.dot(v, w)), i)
            for v in {v for i, v in kept if i == query}
            for i, w in kept if i != query and len(w) == len(v)
        )
        out += [(query, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_repeated_rows_are_candidates_each(spark):
    """Rows of one id, equal or not, and many copies of one row."""
    chance = np.random.default_rng(9)
    rows = [(i % 40, chance.normal(0, 0.3, 6).tolist()) for i in range(90)]
    rows += [rows[3]] * 2 + [rows[7]] * 60 + [rows[0]] * 3 + [(100, rows[7][1]), (100, rows[8][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for blocks in ({}, {"block_vectors": 20, "block_queries": 1}):
        found = vector_search.exact_top_k(df, **blocks).collect()
        assert sorted(map(tuple, found)) == brute_top(rows)


def test_scores_beyond_64_bits_are_an_error(spark):
    rows = [(0, [1e16, 1.0]), (1, [1e16, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="64 bits"):
        vector_search.exact_top_k(df)
    rows = [(0, [1e5, 1.0]), (1, [1e6, 2.0]), (2, [1e300, float("nan")])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, vector_search.exact_top_k(df).collect())) == brute_top(rows)


def test_vectors(spark):
    chance = np.random.default_rng(4)
    rows = [(i, chance.normal(0, 0.3, 8).tolist()) for i in range(230)]
    rows += [(300 + i, rows[0][1]) for i in range(40)] + [rows[50], (50 * 9, [0.0] * 8)]
    rows += [(500, None), (501, []), (502, [float("nan")] * 8), (503, [None] * 8), (None, rows[1][1])]
    rows += [(504, [float("inf")] * 8), (550, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df = df.withColumn("score", F.lit(1))
    rows32 = [(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for blocks in ({}, {"block_vectors": 50, "block_queries": 2}):
        found = vector_search.exact_top_k(df, **blocks).collect()
        assert sorted(map(tuple, found)) == brute_top(rows32)
    assert vector_search.exact_top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize("copies", [300, 600, 2_730])
def test_more_copies_than_first_candidates(copies):
    """Equal bounds beyond the first candidates: every vector is read, and read once."""
    chance = np.random.default_rng(copies)
    vectors = chance.integers(-200, 200, (4_000, 16))
    vectors[chance.choice(4_000, copies, replace=False)] = chance.integers(-200, 200, 16)
    ids = chance.permutation(4_000)
    asked = np.concatenate([np.arange(5), chance.choice(4_000, 15)])
    queries = np.concatenate([vectors[asked], 2 * vectors[asked] + 1])
    query_ids = np.concatenate([ids[asked], np.arange(20) + 9_000])
    expected = []
    for query_id, query in zip(query_ids.tolist(), queries):
        scores = vectors @ query
        best = [i for i in np.lexsort((ids, -scores)) if ids[i] != query_id][:5]
        expected += [(query_id, int(ids[i]), int(scores[i])) for i in best]
    assert vector_search.search_block(ids, vectors, query_ids, queries, 5) == expected


def test_vector_bounds_hold():
    vectors = np.random.default_rng(0).integers(-200, 200, (500, 6))
    numbers, bounds = vector_search.approximate(vectors, 8)
    for query in vectors[:20]:
        assert (vector_search.upper_bounds(query, numbers, bounds) >= vectors @ query).all()


def test_licences(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/c/x", "code\nmore code"), (3, "a/b/LICENSE", "Licensed under CC BY-NC 4.0."),
        (4, "a/y", "no word of it"), (5, "z/q", "some lines of a file that are not about it\nLicensed under the Apache License, Version 2.0."),
        (6, None, "nothing"), (7, "z/r", None), (8, "a/b/w", ""), (8, "a/b/w", ""),
        (9, "a/k", "word " * 20_000 + "\nThis work is licensed under the GNU General Public License, version 3."),
    ]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string")
    found = license_scan.scan_licences(files.withColumn("licence", files["path"])).collect()
    got = sorted((r.doc_id, r.licence, r.inherited, r.licence_dir) for r in found)
    assert [(a, b, c) for a, b, c, _ in got] == [
        (1, "MIT", False), (2, "CC-BY-NC-4.0", True), (3, "CC-BY-NC-4.0", False), (4, "MIT", True),
        (5, "Apache-2.0", False), (6, None, False), (7, None, False), (8, "CC-BY-NC-4.0", True),
        (8, "CC-BY-NC-4.0", True), (9, "GPL-3.0", False),
    ]
    assert {d: x for d, _, _, x in got}[2] == "a/b"
    assert license_scan.scan_licences(files.limit(0)).count() == 0


def test_licences_in_long_lines_and_across_lines(spark):
    code = "function f(a){return a+1} var text = 'some other words of a page'; " * 60
    rows = [
        ("Apache-2.0", code + "Licensed under the Apache License, Version 2.0. " + code),
        ("MIT", code + "/* Released under the MIT License. */" + code),
        ("MIT", "# Permission is hereby\n# granted, free of charge, to any\n# person obtaining a "
         "copy of this software and\n# associated documentation files, to deal in the\n# Software "
         "without restriction\nimport os"),
        ("GPL-3.0", "/* This work is licensed under the GNU\n * General Public License,\n * version 3. */\nint x;"),
        ("GPL-2.0", "Licensed under the GNU General Public License, version 2.\nint x;"),
        ("LGPL-2.1", code + "GNU Lesser General Public License, version 2.1. " + code),
        ("AGPL-3.0", "Licensed under the GNU Affero General\nPublic License, version 3."),
        ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
        ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License."),
        ("CC-BY-4.0", code + "Licensed under CC BY 4.0. " + code),
        ("CC0-1.0", "Licensed under CC0 1.0."),
        ("MPL-2.0", "// This Source Code Form is subject to the terms of the Mozilla\n// Public License, v. 2.0. If a copy"),
        ("ISC", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided"),
        ("Unlicense", "This is free and unencumbered software released into the public domain."),
        ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
        ("BSD-3-Clause", "Copyright (c) 2020 A. All rights reserved.\nRedistribution and use in source and binary forms,\nwith or without modification, are permitted provided that the following conditions are met:"),
        ("Proprietary", code + "Copyright 2020. All rights reserved. " + code),
        (None, code), (None, "Released under the Some Other License."), (None, "without a word of it"),
    ]
    files = spark.createDataFrame(
        [(i, f"d{i}/x", text) for i, (_, text) in enumerate(rows)], "doc_id long, path string, text string"
    )
    beside = spark.createDataFrame([(900, "d0/y", "int y;")], files.schema)
    found = {r.doc_id: r for r in license_scan.scan_licences(files.union(beside)).collect()}
    assert {i: found[i].licence for i in range(len(rows))} == {i: x for i, (x, _) in enumerate(rows)}
    # a sentence in a long line does not make a licence file of it
    assert found[900].licence is None and not found[0].inherited


def test_rows_with_equal_id_and_path(spark):
    """Each text has its own licence, equal rows the same one; missing ids and paths likewise."""
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [
        (1, "a/x", mit), (1, "a/x", apache), (1, "a/x", apache), (1, "a/x", "int x;"), (1, "a/x", None),
        (None, "b/y", mit), (None, "b/y", "int y;"), (None, None, apache), (None, None, "int z;"),
    ]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string").repartition(5)
    found = license_scan.scan_licences(files).collect()
    got = sorted(((r.doc_id, r.path, r.licence, r.inherited) for r in found), key=repr)
    # of the licence files of a/, two state one licence and one the other
    assert got == sorted([
        (1, "a/x", "MIT", False), (1, "a/x", "Apache-2.0", False), (1, "a/x", "Apache-2.0", False),
        (1, "a/x", "Apache-2.0", True), (1, "a/x", "Apache-2.0", True), (None, "b/y", "MIT", False),
        (None, "b/y", "MIT", True), (None, None, "Apache-2.0", False), (None, None, None, False),
    ], key=repr)
