"""The grouped prefix join against comparing all sets."""

import random
from collections import Counter, defaultdict

import pytest

from declarium.llm import jaccard_join
from declarium.llm.common import table


def shingle_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    count = max(1, len(words) - 4) if words else 0
    return frozenset(tuple(words[i : i + 5]) for i in range(count))


def brute(rows):
    """(size, component) of every row."""
    sets = [shingle_set(text) for _, text in rows]
    holders = defaultdict(list)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, own in enumerate(sets):
        shared = Counter(j for g in own for j in holders[g])
        for j, n in shared.items():
            if 100 * n >= 75 * (len(own) + len(sets[j]) - n):
                parent[root(i)] = root(j)
        for g in own:
            holders[g].append(i)
    smallest: dict = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            smallest[root(i)] = min(doc_id, smallest.get(root(i), doc_id))
    return [(len(sets[i]), smallest.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def compare(docs, rows):
    found = jaccard_join.near_duplicates(docs).collect()
    expected = [(d, *e) for (d, _), e in zip(rows, brute(rows))]
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_whole_table(spark, folder):
    docs = table(spark, folder, "documents")
    compare(docs, [(r.doc_id, r.text) for r in docs.collect()])


def test_large_groups_and_chains(make_docs):
    """Variants of one text, a chain that drifts, a shared passage, copies, and odd rows."""
    chance = random.Random(3)
    base = [f"w{i}" for i in range(90)]
    texts = ["", None, "  ", "one two", "ONE  two", "one two three", "one two", "é È"]
    for _ in range(120):
        own = list(base)
        for _ in range(chance.randint(0, 4)):
            own[chance.randrange(len(own))] = f"v{chance.randrange(1000)}"
        texts.append(" ".join(own))
    chain = [f"c{i}" for i in range(60)]
    for step in range(30):
        chain[step * 2] = f"d{step}"
        texts.append(" ".join(chain))
    passage = " ".join(f"p{i}" for i in range(30))
    texts += [f"{passage} " + " ".join(f"q{n}x{i}" for i in range(60)) for n in range(40)]
    texts += [" ".join(base)] * 40 + ["word " * 3000]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    rows += [(None, " ".join(base)), (None, "alone here now ok then"), rows[20], rows[20]]
    compare(make_docs(rows, extra=True), rows)


def test_empty_table(make_docs):
    assert jaccard_join.near_duplicates(make_docs([])).count() == 0
    assert jaccard_join.first_of_groups(make_docs([])).count() == 0


def test_one_document_of_each_group_stays(make_docs):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [
        (5, long), (3, long), (9, long + " more"), (4, ""), (6, None), (7, "short text"),
        (8, "other text"), (8, long), (8, "other text"), (None, "without id at all here"),
        (None, "without id at all here"),
    ]
    docs = make_docs(rows, extra=True)
    kept = jaccard_join.first_of_groups(docs)
    assert kept.columns == docs.columns
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert found == sorted(
        [(3, long), (4, ""), (6, None), (7, "short text"), (8, "other text"),
         (None, "without id at all here")], key=repr,
    )


def test_rows_that_stay_are_not_shuffled(spark, make_docs):
    """Rows are parted in the scan; only those whose id may be listed are joined by shuffle."""
    rows = [(i if i % 9 else None, f"text {i}") for i in range(400)] + [(7, "again"), (-3, "x")]
    docs = make_docs(rows, extra=True).repartition(3)
    ids = spark.createDataFrame([(7,), (-3,), (64,), (4_000,), (None,)], "doc_id long")
    sure, others = jaccard_join.parted(docs, ids, "doc_id")
    assert sure.columns == others.columns == docs.columns
    # the wanted rows by their own numbers, without the split under test
    found = sorted(((r.doc_id, r.text) for r in sure.union(others).collect()), key=repr)
    assert found == sorted(rows, key=repr)
    kept = {r.doc_id for r in sure.collect()}
    assert not kept & {7, -3, 64, None} and len(kept) > 300
    plain = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    stays, _ = jaccard_join.parted(plain, ids, "doc_id")
    stays.collect()
    plan = stays._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning(doc_id" not in plan
    whole = jaccard_join.first_of_groups(plain)
    whole.collect()
    scans = whole._jdf.queryExecution().optimizedPlan().toString()
    assert scans.count("_gone_bits") >= 2


def test_near_copies_with_outliers(make_docs):
    """A group of near copies, and outliers around the limit, some of which link to one member alone."""
    chance = random.Random(11)
    base = [f"w{i}" for i in range(160)]

    def changed(words, times):
        words = list(words)
        for _ in range(times):
            words[chance.randrange(len(words))] = f"x{chance.randint(0, 9999)}"
        return words

    texts = [changed(base, chance.randint(0, 3)) for _ in range(120)]
    texts += [changed(chance.choice(texts[:120]), chance.randint(3, 9)) for _ in range(60)]
    texts += [changed(texts[-1], chance.randint(4, 8)) for _ in range(20)]
    texts += [base[: chance.randint(100, 159)] for _ in range(20)]
    rows = list(enumerate(" ".join(words) for words in texts))
    compare(make_docs(rows), rows)
    assert 1 < len({c for _, c in brute(rows)}) < 100


def test_parities_bound_what_two_sets_share():
    import numpy as np

    chance = np.random.default_rng(3)
    for _ in range(300):
        shared, a, b = (chance.integers(0, 2**63, int(chance.integers(0, n))).astype(np.uint64) for n in (900, 300, 300))
        x, y = np.unique(np.append(shared, a)), np.unique(np.append(shared, b))
        apart = np.bitwise_count(jaccard_join.parities(x).view(np.uint64) ^ jaccard_join.parities(y).view(np.uint64)).sum()
        assert 2 * len(np.intersect1d(x, y)) <= len(x) + len(y) - int(apart)


def test_shingles_of_odd_texts():
    import pyarrow as pa

    texts = [None, "", " \t\n\x0b\x0c\r", "a", "A  a", "é É ß\x85x y z", "\x1ca b c d e f", "x" * 64 + " " + "x" * 65]
    texts += [" ".join(["y" * 100, "z" * 300, "y" * 100, "b", "c", "d", "z" * 300]), "q " * 700_000, "one two three four five six"]
    found = jaccard_join.shingle_lists(pa.array(texts, pa.string()))
    assert [len(v) for v in found] == [len(shingle_set(t)) for t in texts]
    again = jaccard_join.shingle_lists(pa.array(["x", *texts], pa.string()).slice(1))
    for a, b in zip(found, again):
        assert a.tolist() == b.tolist()
    alone = [jaccard_join.shingle_lists(pa.array([t], pa.string()))[0].tolist() for t in texts]
    assert alone == [v.tolist() for v in found]
    assert jaccard_join.shingle_lists(pa.array([], pa.string())) == []
