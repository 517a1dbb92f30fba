"""Spelling variants against comparing words by their own deletions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from declarium.llm import spelling_variants
from declarium.llm.common import table

ALPHABET = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def brute(rows, garbled=True):
    counts: Counter = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            if garbled and doc_id is not None:
                h = zlib.crc32(f"{doc_id}:{run}".encode())
                if h % 31 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            if w[:i] + w[i + 1 :] in words:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    holes = defaultdict(list)
    for w in words:
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :]].append(w)
    for same in holes.values():
        for w in same:
            near[w].update(v for v in same if v != w)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 10 * n:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return sorted(out, key=repr)


def compare(docs, rows, garbled=True, shards=None):
    found = spelling_variants.spelling_variants(docs, garbled, shards)
    names = ("word", "form", "root", "n", "n_near", "form_n")
    assert sorted(map(tuple, found.select(*names).collect()), key=repr) == brute(rows, garbled)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_whole_table(spark, folder):
    docs = table(spark, folder, "documents")
    compare(docs, [(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_edits_everywhere(make_docs, shards, monkeypatch):
    """Words with edits at every place, runs of one letter, many words with one beginning."""
    monkeypatch.setattr(spelling_variants, "READ", 3)
    monkeypatch.setattr(spelling_variants, "ASKED", 50)
    monkeypatch.setattr(spelling_variants, "COUNTED", 100)
    chance = random.Random(shards)
    words = ["a" * 7, "a" * 8, "aaaabaaaa", "aaaaaaab", "ÿ" * 9, "ÿ" * 8, "×÷×÷×÷×", "x" * 500, "x" * 501]
    words += ["common" + "".join(chance.choice("abc") for _ in range(chance.randint(1, 5))) for _ in range(150)]
    words += ["".join(chance.choice("ab") for _ in range(chance.randint(7, 9))) for _ in range(150)]
    words += ["ÿÿÿÿ" + "".join(chance.choice("aÿ") for _ in range(5)) for _ in range(20)]
    base = "Übermäßige"
    for i in range(len(base) + 1):
        words.append(base[:i] + chance.choice(ALPHABET) + base[i:])
        words.append(base[:i] + base[i + 1 :])
        words.append(base[:i] + chance.choice(ALPHABET) + base[i + 1 :])
    texts = [" ".join([w] * chance.choice([2, 2, 3, 25, 300])) for w in words] + [base + "! " + base]
    chance.shuffle(texts)
    rows = list(enumerate(texts))
    compare(make_docs(rows), rows, shards=shards)
    compare(make_docs(rows), rows, garbled=False, shards=shards)


def test_odd_rows(make_docs):
    """Missing texts and ids, repeated rows, separators, letters beyond the alphabet."""
    rows = [
        (1, None), (2, ""), (None, "spelling SPELLING"), (3, "spellingĀspelling"), (3, "spellingĀspelling"),
        (4, "x" * 100_000 + " " + "x" * 100_000 + "1" + "x" * 99_999), (4, "spellin9 spellling_spellling"),
        (5, "中spelling文 " * 30), (6, "shorts shorts"), (7, "É" * 7 + "\n" + "É" * 7 + "é"),
    ]
    compare(make_docs(rows, extra=True), rows)
    assert compare(make_docs([]), []) is None


def test_nothing_near(make_docs):
    compare(make_docs([(1, "lonesome lonesome")]), [(1, "lonesome lonesome")], garbled=False)
