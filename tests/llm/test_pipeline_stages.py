"""Every stage of the pipeline against brute force, on what the stage before has kept."""

import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from test_decontaminate import brute as hits_of
from test_near_duplicates import brute as components_of
from test_tokens import expected_rows
from tokenizers import Tokenizer

import corpus_pipeline
from declarium.llm import mixture, token_blocks
from declarium.llm.common import table
from declarium.llm.decontaminate import words_of

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before and after every stage; odd rows join the documents."""
    docs = table(spark, FOLDER, "documents")
    odd = spark.createDataFrame(
        [(10_001, None, "en", "x", 0), (10_002, "", None, None, 0), (10_003, "12 34", "en", "x", 5),
         (None, docs.first().text, "en", None, 1)],
        docs.schema,
    )
    docs = docs.unionByName(odd).unionByName(docs.where("doc_id % 10 = 0"))
    kept = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, FOLDER)
        kept.append(rows.collect())
        docs = spark.createDataFrame(kept[-1], rows.schema) if kept[-1] else rows
    return kept


def ids(rows):
    return Counter(r.doc_id for r in rows)


def test_language(stages):
    """Nothing with a letter goes from the given documents, and nothing without one stays."""
    before, after = stages[0], stages[1]
    expected = [r for r in before if r.text and any(c.isalpha() for c in r.text)]
    assert ids(after) == ids(expected) and before[0].__fields__ == after[0].__fields__


def test_near_duplicates(stages):
    before, after = stages[1], stages[2]
    found = components_of([(r.doc_id, r.text) for r in before])
    groups = {c if n else (r.doc_id, "empty") for r, (n, c) in zip(before, found)}
    assert len(after) == len(groups)
    # one row a component: the first id, or, where no row has one, any of its rows
    assert ids(after) == Counter(g for g in groups if not isinstance(g, tuple))


def test_benchmark(spark, stages):
    before, after = stages[2], stages[3]
    items = [(r.item_id, words_of(r.text)) for r in table(spark, FOLDER, "benchmark").collect()]
    grams = defaultdict(set)
    for item, words in items:
        size = min(10, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            grams[tuple(words[i : i + size])].add(item)
    sizes = {len(g) for g in grams}
    expected = {}
    for row in before:
        words, hit = words_of(row.text), set()
        for size in sizes:
            for j in range(len(words) - size + 1):
                if tuple(words[j : j + size]) in grams:
                    hit |= set(range(j, j + size))
        if 2 * len(hit) <= len(words):
            expected[row.doc_id] = [w for i, w in enumerate(words) if i not in hit]
    assert {r.doc_id: words_of(r.text) for r in after} == expected
    assert {r.doc_id for r in before} != set(expected) or any(
        len(words_of(r.text)) != len(expected[r.doc_id]) for r in before if r.doc_id in expected
    )
    assert hits_of(items[:1], items[0][1], 10)[1] == {items[0][0]}  # the brute force of the operator's tests
    for r in after:
        assert r.n_chars == len(r.text) or r.text in {b.text for b in before}


def test_mix(spark, stages):
    before, after = stages[3], stages[4]
    docs = spark.createDataFrame(before)
    taken = {r.doc_id: (r.taken, r.size) for r in mixture.mixture(docs).collect()}
    for doc, (words, size) in taken.items():
        own = next(r for r in before if r.doc_id == doc)
        assert size == len(re.findall(r"[^\x20\x09-\x0D]+", own.text)) and 0 <= words <= 3 * size
    expected = Counter({d: int(np.floor(t / s + 0.5)) for d, (t, s) in taken.items() if s})
    assert ids(after) == +expected
    texts = {r.doc_id: r.text for r in before}
    assert all(r.text == texts[r.doc_id] for r in after)


def test_tokens(stages):
    before, after = stages[4], stages[5]
    bpe = Tokenizer.from_file(public_tokenizers.path(token_blocks.TOKENIZER))
    pairs = sorted(((r.doc_id, r.text) for r in before), key=lambda p: (p[0] is not None, p[0] or 0, p[1] or ""))
    assert sorted(map(tuple, after), key=lambda r: r[1]) == expected_rows(bpe, pairs)
