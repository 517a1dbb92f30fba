"""SimHash near-duplicates against comparing all fingerprints."""

import random
import re

import numpy as np
import pytest
import xxhash

from declarium.llm import simhash
from declarium.llm.common import table


def brute_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps):
    """The component of every fingerprint, as its smallest member."""
    values = sorted(set(fps))
    every = np.array(values, np.uint64)
    label = {v: v for v in values}

    def root(v):
        while label[v] != v:
            v = label[v]
        return v

    for v in values:
        for other in every[np.bitwise_count(every ^ np.uint64(v)) <= 3].tolist():
            a, b = sorted((root(v), root(other)))
            label[b] = a
    return {v: root(v) for v in values}


def compare(docs, rows, **how):
    fps = [brute_fingerprint(text) for _, text in rows]
    label, least = groups(fps), {}
    for (doc_id, _), fp in zip(rows, fps):
        if doc_id is not None:
            least[label[fp]] = min(doc_id, least.get(label[fp], doc_id))
    expected = [(d, f"{fp:016x}", least.get(label[fp])) for (d, _), fp in zip(rows, fps)]
    found = simhash.near_duplicates(docs, **how).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_whole_table(spark, folder):
    docs = table(spark, folder, "documents")
    compare(docs, [(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("members", [3, 50_000])
def test_near_copies_and_odd_rows(make_docs, members, monkeypatch):
    """Many near copies of one text, chains of them, missing and wordless texts, missing ids."""
    monkeypatch.setattr(simhash, "SMALL", 4)
    monkeypatch.setattr(simhash, "HOT_DOCUMENTS", 5)
    monkeypatch.setattr(simhash, "DEALT", 50)
    monkeypatch.setattr(simhash, "SHINGLES", 64)
    chance = random.Random(members)
    base = [f"w{chance.randint(0, 300)}" for _ in range(400)]
    texts = ["", None, " \t\n\x0b\x0c\r ", "one", "ONE two", "one  TWO", "é É", "\x1c \x85 x", "x " * 50_000]
    for _ in range(150):
        words = list(base)
        for _ in range(chance.randint(0, 3)):
            words[chance.randrange(400)] = "other"
        texts.append(" ".join(words))
        base[chance.randrange(400)] = "drift" if chance.random() < 0.3 else base[0]
    texts += [texts[20]] * 40 + [" ".join(chance.choice("abcdefgh") for _ in range(9)) for _ in range(60)]
    rows = [(i if i % 17 else None, text) for i, text in enumerate(texts)] + [(3, "one"), (3, "three")]
    compare(make_docs(rows, extra=True), rows, members=members)


def test_all_distances_in_a_crowd(spark):
    """Fingerprints that share a segment, with one to four bits apart, cut again or not."""
    chance = random.Random(5)
    fps = set()
    for _ in range(40):
        centre = chance.getrandbits(64) & ~0xFFFFFFFF | (7 if chance.random() < 0.7 else chance.getrandbits(32))
        for _ in range(8):
            flips = chance.sample(range(64), chance.randint(1, 4))
            fps |= {centre, centre ^ sum(1 << b for b in flips)}
    fps |= {chance.getrandbits(8) << 32 | 7 for _ in range(200)}
    signed = [(int(np.uint64(fp).view(np.int64)),) for fp in sorted(fps)]
    label = groups(sorted(fps))
    for members in (2, 50_000):
        links = simhash.links(spark.createDataFrame(signed, "fp long"), members).collect()
        own = {fp: fp for fp in fps}

        def root(v):
            while own[v] != v:
                v = own[v]
            return v

        for a, b in links:
            a, b = a % 2**64, b % 2**64
            assert 0 < (a ^ b).bit_count() <= 3
            a, b = sorted((root(a), root(b)))
            own[b] = a
        assert {fp: root(fp) for fp in fps} == label


def test_dealing_many_fingerprints_takes_little_memory():
    """All variants of all fingerprints reach a task, made for a bounded number of them at once."""
    import tracemalloc

    fps = np.random.default_rng(2).integers(0, 2**63, 70_000).astype(np.uint64)
    none = np.empty(0, np.uint64)
    tracemalloc.start()
    pairs = 0
    for batch in simhash.packed(fps, (none, none), 40):
        sizes = [len(c.as_py()) // 2 for c in batch.column(1)]
        assert sizes == [len(f.as_py()) // 8 for f in batch.column(2)]
        pairs += sum(sizes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pairs == len(fps) * 2 * simhash.VARIANTS
    assert peak < 160e6


def test_rows_without_any_id(make_docs):
    compare(make_docs([(None, "a b c"), (None, "a b c")]), [(None, "a b c"), (None, "a b c")])


def test_empty_table(make_docs):
    assert simhash.near_duplicates(make_docs([])).count() == 0
