"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from ancestor directories.

Passages that speak of licences are compared with templates as sparse vectors; a file takes the
licence of its best passage. A file that is mostly such passages is the licence file of its
directory; files without a licence take that of the nearest directory above that has one.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from declarium.llm.common import shared_table

GNU = "GNU {} License, version {}."
PROGRAM = (
    "This program is free software: you can redistribute it and/or modify it under the terms of "
    "the GNU {} License as published by the Free Software Foundation, either version {} of the "
    "License, or (at your option) any later version."
)
CREATIVE = "This work is licensed under a Creative Commons {} {} International License."

# How licences are usually stated, each with the terms that name the licence: a
# passage without one of these states another licence.
TEMPLATES: dict[str, list[tuple[str, str]]] = {
    "Apache-2.0": [
        ("Licensed under the Apache License, Version 2.0.", "apache 2.0"),
        ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file "
         "except in compliance with the License.", "apache 2.0"),
        ("Unless required by applicable law or agreed to in writing, software distributed under "
         "the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
         "KIND, either express or implied.", "unless basis conditions"),
    ],
    "BSD-2-Clause": [
        ("Released under the BSD 2-Clause License.", "bsd 2-clause"),
        ("Released under the Simplified BSD License.", "bsd simplified"),
        ("and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE "
         "COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS", "materials distribution provided holders"),
    ],
    "BSD-3-Clause": [
        ("Redistribution and use in source and binary forms, with or without modification, are "
         "permitted provided that the following conditions are met", "redistribution binary"),
        ("Use of this source code is governed by a BSD-style license.", "bsd-style"),
        ("Released under the BSD 3-Clause License.", "bsd 3-clause"),
        ("Neither the name of the copyright holder nor the names of its contributors may be used "
         "to endorse or promote products derived from this software without specific prior "
         "written permission", "neither endorse"),
    ],
    "CC-BY-4.0": [
        ("Licensed under CC BY 4.0.", "cc by 4.0"),
        (CREATIVE.format("Attribution", "4.0"), "creative attribution 4.0"),
    ],
    "CC0-1.0": [
        ("Licensed under CC0 1.0.", "cc0"),
        ("Released under the Creative Commons CC0 1.0 Universal Public Domain Dedication.", "cc0"),
    ],
    "ISC": [
        ("Released under the ISC License.", "isc"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with "
         "or without fee is hereby granted", "permission fee"),
    ],
    "MIT": [
        ("Released under the MIT License.", "mit"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this "
         "software and associated documentation files, to deal in the Software without "
         "restriction", "permission charge person"),
    ],
    "MPL-2.0": [
        ("Licensed under the Mozilla Public License, version 2.0.", "mozilla 2.0"),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
         "mozilla 2.0"),
    ],
    "Unlicense": [
        ("Released under the Unlicense.", "unlicense"),
        ("This is free and unencumbered software released into the public domain.",
         "unencumbered domain"),
    ],
    "Proprietary": [
        ("All rights reserved.", "rights reserved"),
        ("Copyright. All rights reserved.", "rights reserved"),
    ],
}
for short, name, word in [
    ("GPL", "General Public", "general"), ("LGPL", "Lesser General Public", "lesser"),
    ("AGPL", "Affero General Public", "affero"),
]:
    for number in {"GPL": ["2", "3"], "LGPL": ["2.1", "3"], "AGPL": ["3"]}[short]:
        full = number if "." in number else number + ".0"
        TEMPLATES[f"{short}-{full}"] = [
            (intro + GNU.format(name, number), f"gnu {word} {number}")
            for intro in ("", "Licensed under the ", "This work is licensed under the ")
        ] + [
            (PROGRAM.format(name, number), f"gnu {word} {number}"),
            (f"Licensed under the {short}v{number}.", f"{short.lower()}v{number}"),
            (f"SPDX-License-Identifier: {short}-{full}-only", f"{short.lower()}-{full}-only"),
            (f"SPDX-License-Identifier: {short}-{full}-or-later",
             f"{short.lower()}-{full}-or-later"),
        ]
for short, name in [
    ("BY-NC", "Attribution-NonCommercial"), ("BY-SA", "Attribution-ShareAlike"),
    ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
]:
    TEMPLATES[f"CC-{short}-4.0"] = [
        (f"Licensed under CC {short} 4.0.", f"cc {short.lower()} 4.0"),
        (CREATIVE.format(name, "4.0"), f"creative {name.lower()} 4.0"),
    ]
for name, own in TEMPLATES.items():
    if name != "Proprietary":
        own += [
            (f"SPDX-License-Identifier: {name}", name.lower()),
            (f"Licensed under {name}.", name.lower()),
        ]
TRIGGER = (
    r"(?i)\blicen[sc]e|\bcopyright\b|\ball rights reserved\b|\bspdx\b|\bpermission is hereby\b"
    r"|\bredistribution and use\b|\bwithout warrant|\bcreative commons\b|\bcc[- ]by\b"
    r"|\bcc0\b|\bunlicen[sc]e|\bunencumbered software\b|\bpermission to use\b|\b[al]?gplv\d"
)
# Where windows begin to be sought: also first words whose statement may go on in the next line.
ANCHOR = (
    TRIGGER + r"|\bunencumbered\b|\bpermission\b|\bredistribution\b|\bneither the"
    r"|\bmaterials provided\b|\bwithout\b|\ball rights\b|\bcreative\b"
)
TERM = r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"
WORD = r"[^\x20\x09-\x0D]+"
LEAST_COSINE = 0.6
# Share of a file's words in licence passages from which it is a licence file.
LICENCE_FILE = 0.5
# Words of a line that count as speaking of licences, for every trigger in it.
REACH = 50


TERM_HERE = r"[^\W_]+(?:[.-][^\W_]+)*"


def terms(text: str) -> list[str]:
    return re.findall(TERM_HERE, text.lower())


def shapes() -> list[tuple[int, int, frozenset[str], dict[str, int], int]]:
    """For every template and anchor in it: terms before the anchor, length, the terms that name
    the licence, all terms, the template's number."""
    out = []
    every = [(text, key) for _, own in sorted(TEMPLATES.items()) for text, key in own]
    for number, (text, key) in enumerate(every):
        found = list(re.finditer(TERM_HERE, text.lower()))
        starts = [m.start() for m in found]
        places = {bisect_right(starts, m.start()) - 1 for m in re.finditer(ANCHOR, text)}
        counts = Counter(m[0] for m in found)
        out += [
            (p, len(found), frozenset(key.split()), counts, number) for p in sorted(places) if p >= 0
        ]
    return out


def window_finder(weights: dict[str, float], least: float):
    """A function from a text to its windows that a template may match.

    A window stands around an anchor as its template does, whatever line ends it crosses. Known
    terms have their weights and others count at least 1, so a window that cannot reach ``least``
    is left out; no other one is.
    """
    made = []
    for before, size, key, counts, _ in shapes():
        own = {t: n * weights[t] for t, n in counts.items()}
        norm = math.sqrt(sum(w * w for w in own.values()))
        made.append((before, size, key, {t: w / norm for t, w in own.items()}))

    def find(text: str) -> set[str]:
        lower = text.lower()
        found = list(re.finditer(TERM_HERE, lower))
        words, starts = [m[0] for m in found], [m.start() for m in found]
        out: set[str] = set()
        for anchor in re.finditer(ANCHOR, lower):
            at = bisect_right(starts, anchor.start()) - 1
            for before, size, key, share in made if at >= 0 else ():
                low = max(0, at - before)
                own = words[low : at - before + size]
                if not key.issubset(own):
                    continue
                dot = norm = 0.0
                for term, n in Counter(own).items():
                    w = n * weights.get(term, 1.0)
                    norm += w * w
                    dot += w * share.get(term, 0.0)
                if dot >= (least - 1e-6) * math.sqrt(norm):
                    out.add(" ".join(own))
        return out

    return find


# What tells rows apart: two rows equal in all of these have equal texts.
FILE = ["id", "path", "h1", "h2"]


def digest(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def parent(path: Column) -> Column:
    """The directory of a path; the root is the empty string."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan_licences(
    files: DataFrame,
    id_column: str = "doc_id",
    path_column: str = "path",
    text_column: str = "text",
    least: float = LEAST_COSINE,
) -> DataFrame:
    """id, path, licence, score, inherited, licence_dir of every row.

    Every line of every whole text that speaks of licences is a passage; weights are term count
    times log((1 + passages) / (1 + passages with the term)) + 1, counted over all files. Windows
    of words around what may begin a statement, also across line ends, are passages besides, but
    do not count for weights. The best template whose naming terms all stand in the passage wins,
    ties to the first by name; reserved rights give way to any licence. Null and empty texts have no passage and may
    inherit; without a path nothing is inherited. A directory with several licence files has the
    licence of most of them, ties to the first by name. ``score`` is 0 where nothing was found,
    and that of the own passage else. Equal rows give a row each; rows with equal id and path but
    other texts have each their own licence.
    """
    spark = files.sparkSession
    rows = files.select(
        F.col(id_column).alias("id"), F.col(path_column).alias("path"),
        F.col(text_column).alias("text"), *digest(F.col(text_column)),
    )
    spoken = (
        rows.where(F.col("text").rlike(TRIGGER))
        .select(
            *FILE,
            F.regexp_count("text", F.lit(WORD)).alias("words"),
            F.posexplode(F.split("text", "\n")).alias("line", "passage"),
        )
        .where(F.col("passage").rlike(TRIGGER))
    )
    # equal passages, wherever they stand, are compared once
    spoken = shared_table(spoken.drop("line"), "passages")
    lines = spoken.groupBy("passage").agg(F.count(F.lit(1)).alias("times"))
    every_term = F.explode(F.regexp_extract_all(F.lower("passage"), F.lit(TERM), 0)).alias("term")
    total = lines.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    # how often template terms occur, for the templates' own weights: as many rows as terms
    known = sorted({t for own in TEMPLATES.values() for text, _ in own for t in terms(text)})
    with_term = lines.select("passage", "times", every_term).distinct().groupBy("term").agg(F.sum("times").alias("df"))
    frequency = {r.term: r.df for r in with_term.where(F.col("term").isin(known)).collect()}

    def weight(df: float) -> float:
        return math.log((1 + total) / (1 + df)) + 1

    vectors = []
    for licence, texts in sorted(TEMPLATES.items()):
        for number, (text, key) in enumerate(texts):
            own = {t: n * weight(frequency.get(t, 0)) for t, n in Counter(terms(text)).items()}
            norm = math.sqrt(sum(w * w for w in own.values()))
            naming = set(key.split())
            vectors += [
                (licence, number, t, w / norm, int(t in naming), len(naming)) for t, w in own.items()
            ]
    templates = spark.createDataFrame(
        vectors,
        "licence string, number int, term string, share double, naming int, names int",
    )
    weights = {t: weight(frequency.get(t, 0)) for t in known}

    def find_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = window_finder(weights, least)
        for batch in batches:
            places, windows = [], []
            for place, text in enumerate(batch.column(len(FILE)).to_pylist()):
                found = sorted(find(text))
                places += [place] * len(found)
                windows += found
            rows_of = batch.select([*FILE, "words"]).take(pa.array(places, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [*rows_of.columns, pa.array(windows, pa.string())], names=[*FILE, "words", "passage"]
            )

    kind = files.schema[id_column].dataType.simpleString()
    windows = shared_table(
        rows.where(F.col("text").rlike(ANCHOR))
        .select(*FILE, "text", F.regexp_count("text", F.lit(WORD)).alias("words"))
        .mapInArrow(
            find_windows, f"id {kind}, path string, h1 long, h2 long, words int, passage string"
        ),
        "windows",
    )
    # what is compared: distinct lines and windows
    counted = (
        spoken.select("passage").union(windows.select("passage")).distinct()
        .select("passage", every_term)
        .groupBy("passage", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    idf = F.log((F.lit(1.0) + total) / (1 + F.coalesce("df", F.lit(0)))) + 1
    weighted = counted.join(with_term, "term", "left").withColumn("w", F.col("tf") * idf)
    norms = weighted.groupBy("passage").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    cosines = (
        weighted.join(F.broadcast(templates), "term")  # the templates above
        .groupBy("passage", "licence", "number")
        .agg(
            F.sum(F.col("w") * F.col("share")).alias("dot"),
            (F.sum("naming") == F.max("names")).alias("named"),
        )
        .where("named")
        .join(norms, "passage")
        .select("passage", "licence", F.round(F.col("dot") / F.col("norm"), 9).alias("score"))
        .where(F.col("score") >= least)
    )
    reserved = (F.col("licence") == "Proprietary").alias("reserved")
    first = F.struct(reserved, (-F.col("score")).alias("s"), "licence")
    best = cosines.groupBy("passage").agg(F.min(first).alias("best"))
    words = F.regexp_count("passage", F.lit(WORD))
    near = F.least(words, REACH * F.regexp_count("passage", F.lit(TRIGGER)))
    found = (
        spoken.withColumn("spoken", near)
        .unionByName(windows, allowMissingColumns=True)
        .join(best, "passage", "left")
    )
    own = shared_table(
        found.groupBy(*FILE).agg(
            F.min("best").alias("best"),
            # lines, or the longest window that states a licence across lines
            F.greatest(
                F.sum("spoken"), F.max(F.when(F.col("spoken").isNull() & F.col("best").isNotNull(), words))
            ).alias("spoken"),
            F.max("words").alias("words"),
        ),
        "licences",
    )
    votes = (
        own.where(F.col("best").isNotNull() & F.col("path").isNotNull())
        .where(F.col("spoken") >= LICENCE_FILE * F.col("words"))
        .groupBy(parent(F.col("path")).alias("dir"), F.col("best.licence").alias("licence"))
        .agg(F.count(F.lit(1)).alias("files"))
    )
    directories = votes.groupBy("dir").agg(
        F.min(F.struct((-F.col("files")).alias("f"), "licence"))["licence"].alias("licence")
    )
    # ancestors of distinct directories, not of files: a directory full of files counts once
    parts = F.split("dir", "/")
    above = (
        rows.where(F.col("path").isNotNull())
        .select(parent(F.col("path")).alias("dir"))
        .distinct()
        .withColumn("depth", F.explode(F.sequence(F.lit(0), F.size(parts))))
        .withColumn("above", F.concat_ws("/", F.slice(parts, F.lit(1), F.col("depth"))))
    )
    nearest = (
        above.join(directories.withColumnRenamed("dir", "above"), "above")
        .groupBy("dir")
        .agg(F.max(F.struct("depth", "above", "licence")).alias("near"))
    )
    taken = own.where(F.col("best").isNotNull()).select(*FILE, "best")
    a, b = rows.drop("text").withColumn("dir", parent(F.col("path"))).alias("a"), taken.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in FILE]
    licensed = a.join(b, same, "left").select("a.id", "a.path", "a.dir", "b.best")
    return licensed.join(nearest, "dir", "left").select(
        F.col("id").alias(id_column),
        F.col("path").alias(path_column),
        F.coalesce("best.licence", "near.licence").alias("licence"),
        F.coalesce(-F.col("best.s"), F.lit(0.0)).alias("score"),
        (F.col("best").isNull() & F.col("near").isNotNull()).alias("inherited"),
        F.when(F.col("best").isNull(), F.col("near.above")).alias("licence_dir"),
    )


def paths_of(docs: DataFrame) -> DataFrame:
    """Documents as files: the source, and directories from the digits of the id."""
    digits = F.regexp_replace(F.col("doc_id").cast("string"), r"(\d)(?=\d)", "$1/")
    return docs.select(
        "doc_id", F.concat_ws("/", F.coalesce("source", F.lit("unknown")), digits).alias("path"),
        "text",
    )


def scan_documents(docs: DataFrame) -> DataFrame:
    return scan_licences(paths_of(docs))
