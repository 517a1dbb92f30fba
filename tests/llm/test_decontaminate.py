"""The suffix automaton against comparing every window."""

import hashlib
import random

from declarium.llm import decontaminate
from declarium.llm.common import table
from declarium.llm.decontaminate import SuffixAutomaton, words_of


def brute(items, words, window):
    hit, found = [False] * len(words), set()
    for item, own in items:
        size = min(window, len(own))
        for i in range(len(own) - size + 1 if own else 0):
            for j in range(len(words) - size + 1):
                if words[j : j + size] == own[i : i + size]:
                    found.add(item)
                    hit[j : j + size] = [True] * size
    return hit, found


def test_random_texts():
    chance = random.Random(5)
    for _ in range(400):
        letters = [bytes([97 + i]) for i in range(chance.choice([2, 3, 6]))]
        window = chance.choice([1, 2, 3, 5])
        items = [
            (i, [chance.choice(letters) for _ in range(chance.randint(0, 8))])
            for i in range(chance.randint(0, 5))
        ]
        words = [chance.choice([*letters, b"zz"]) for _ in range(chance.randint(0, 30))]
        ranges, found = SuffixAutomaton(items, window).hits(words)
        hit = [any(b <= i < e for b, e in ranges) for i in range(len(words))]
        assert (hit, found) == brute(items, words, window)


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    items = table(spark, "/root/testdata/sf0.001", "benchmark")
    held = [(r.item_id, words_of(r.text)) for r in items.collect()]
    grams: dict = {}
    for item, words in held:
        size = min(10, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            grams.setdefault((size, tuple(words[i : i + size])), set()).add(item)
    texts = {r.doc_id: r.text for r in docs.collect()}
    sizes = {size for size, _ in grams}
    dirty = 0
    for row in decontaminate.benchmark_hits(docs, items).collect():
        words, hit, found = words_of(texts[row.doc_id]), set(), set()
        for size in sizes:
            for j in range(len(words) - size + 1):
                own = grams.get((size, tuple(words[j : j + size])))
                if own:
                    found |= own
                    hit |= set(range(j, j + size))
        names = ",".join(sorted(map(str, found)))
        assert (row.n_words, row.n_hit, row.n_items) == (len(words), len(hit), len(found))
        assert row.items_sha256 == hashlib.sha256(names.encode()).hexdigest()
        assert row.contaminated == bool(hit)
        dirty += bool(hit)
    assert dirty


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_spans_go_and_clean_texts_stay(spark, make_docs):
    passage = " ".join(f"w{i}" for i in range(12))
    own = " ".join(f"x{i}" for i in range(30))
    rows = [
        (1, f"{own}, {passage.upper()}. End", "en", "a"), (2, own, "en", "a"), (3, passage),
        (4, None), (5, ""), (None, own), (2, own, "en", "a"),
    ]
    docs = make_docs(rows, extra=True)
    items = items_of(spark, [(1, passage), (1, passage), (2, None), (3, "")])
    kept = decontaminate.remove_spans(docs, items)
    assert kept.columns == docs.columns
    found = sorted(((r.doc_id, r.text, r.n_chars) for r in kept.collect()), key=repr)
    clean = f"{own}, . End"
    assert found == sorted(
        [(1, clean, len(clean)), (2, own, len(own)), (2, own, len(own)), (4, None, 0),
         (5, "", 0), (None, own, len(own))], key=repr,
    )


def test_no_items(spark, make_docs):
    docs = make_docs([(1, "a b c"), (2, None)])
    found = decontaminate.benchmark_hits(docs, items_of(spark, [])).collect()
    assert [(r.n_words, r.n_hit) for r in sorted(found, key=lambda r: r.doc_id)] == [(3, 0), (0, 0)]
    assert decontaminate.benchmark_hits(make_docs([]), items_of(spark, [])).count() == 0


def test_several_automata_agree(spark, make_docs, monkeypatch):
    items = items_of(spark, [(i, " ".join(f"w{i + j}" for j in range(14))) for i in range(20)])
    docs = make_docs([(1, " ".join(f"W{j}," for j in range(25)))])
    one = decontaminate.contamination(docs, items).collect()
    monkeypatch.setattr(decontaminate, "AUTOMATON_WORDS", 30)
    assert decontaminate.contamination(docs, items).collect() == one


def test_many_parts_on_the_tables(spark, monkeypatch):
    """Parts of a few items each give what one automaton gives, cut texts and repeated rows included."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    docs = docs.union(docs.where("doc_id % 3 = 0"))
    items = table(spark, "/root/testdata/sf0.001", "benchmark")

    def results():
        hits = decontaminate.benchmark_hits(docs, items).collect()
        return sorted(map(tuple, hits)), sorted(map(repr, decontaminate.remove_spans(docs, items).collect()))

    one = results()
    assert any(row[-1] for row in one[0]) and len(one[0]) == docs.count()
    monkeypatch.setattr(decontaminate, "AUTOMATON_WORDS", 300)
    parts = list(decontaminate.parts_of(items, 10, "item_id", "text", None))
    assert len(parts) > 3
    assert results() == one


def test_overlapping_hits_of_several_parts(spark, make_docs):
    """Ranges of one document from several automata are joined, and items named once."""
    words = [f"w{i}" for i in range(60)]
    items = items_of(spark, [(i % 7, " ".join(words[i : i + 12])) for i in range(0, 48, 2)] + [(None, words[50])])
    docs = make_docs([(1, " ".join(words)), (1, " ".join(words)), (None, " ".join(words[:11])), (2, "clean")])
    one = sorted(map(repr, decontaminate.contamination(docs, items).collect()))
    many = sorted(map(repr, decontaminate.contamination(docs, items, part_words=15).collect()))
    assert one == many and len(one) == 4


def test_rows_are_cut_in_slices_of_their_batches(spark, make_docs, monkeypatch):
    passage = " ".join(f"w{i}" for i in range(12))
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    rows = [(i, f"{'a ' * (i % 7)}{passage} {'b ' * 30}" if i % 3 else "c " * (i % 5)) for i in range(90)]
    rows += [(90, None), (91, ""), (None, passage)]
    docs = make_docs(rows, extra=True).coalesce(1)
    kept = sorted(map(str, decontaminate.remove_spans(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 100)
    assert sorted(map(str, decontaminate.remove_spans(docs, items).collect())) == kept
    assert len(kept) == 92 and not any("w3" in row for row in kept)
    parts = docs.select("doc_id", "text").toArrow().combine_chunks().to_batches()
    assert sum(1 for batch in parts for _ in decontaminate.slices(batch, 1, 100)) > 10
