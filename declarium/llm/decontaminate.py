"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds every run of consecutive words of every item. Training words are streamed
through it; at each word it knows the longest run, ending there, that some item contains. Where
that reaches a window, the words of the window are hit.

Items are dealt to parts of bounded size by a hash. Only the words of one part at a time pass through
the driver; its automaton is built by the workers that stream documents through it. With several
parts the documents are scanned once for each, and the ranges found are merged by document.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from declarium.llm.common import CACHES, give_back, make_room, map_arrow, shared_table, slices

WINDOW = 10
# Documents with more than this share of hit words are dropped by remove_spans.
MAX_COVERAGE = 0.5
# Words of items in one automaton (a few hundred bytes a word in every worker), on average; more
# items make further automata, each with a scan of its own.
AUTOMATON_WORDS = 400_000
# Bytes of text of whole rows that are cut at once.
SLICE_BYTES = 4 << 20

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
# Upper to lower case; every other byte that is not in a word becomes a space.
TO_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(TO_WORDS).split() if text else []


class SuffixAutomaton:
    """All runs of words of the given items, with the items that contain each window."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.shortest = window
        paths = []
        for item, words in items:
            if words:
                codes = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
                self.shortest = min(self.shortest, len(codes))
                last = 0
                for code in codes:
                    last = self._extend(last, code)
                paths.append((item, codes))
        # items of a window: those that reach its state; short items: where they end
        self.items: dict[int, set] = {}
        self.short: dict[int, list[tuple[int, object]]] = {}
        for item, codes in paths:
            state = length = 0
            for code in codes:
                state, length = self.next[state][code], length + 1
                if length >= window:
                    self.items.setdefault(self._holding(state, window), set()).add(item)
            if length < window:
                self.short.setdefault(state, []).append((length, item))
        # the nearest state up the suffix links, itself included, where a short item ends
        self.ending = [-1] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.ending[state] = state if state in self.short else self.ending[self.link[state]]

    def _extend(self, last: int, code: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        if code in nexts[last]:
            target = nexts[last][code]
            if length[target] == length[last] + 1:
                return target
            return self._clone(last, code, target)
        new = self._state(length[last] + 1)
        while last >= 0 and code not in nexts[last]:
            nexts[last][code] = new
            last = link[last]
        if last < 0:
            link[new] = 0
        else:
            target = nexts[last][code]
            same = length[target] == length[last] + 1
            link[new] = target if same else self._clone(last, code, target)
        return new

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.length) - 1

    def _clone(self, last: int, code: int, target: int) -> int:
        clone = self._state(self.length[last] + 1)
        self.next[clone] = dict(self.next[target])
        self.link[clone], self.link[target] = self.link[target], clone
        while last >= 0 and self.next[last].get(code) == target:
            self.next[last][code] = clone
            last = self.link[last]
        return clone

    def _holding(self, state: int, size: int) -> int:
        """The state of the last ``size`` words of what led to this state."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Half-open ranges of hit words, in order and apart, and the items with windows there."""
        codes = np.fromiter(
            map(self.vocabulary.get, words, repeat(-1)), np.int32, count=len(words)
        )
        # a word of no item ends every match: only runs of known words can hold a window
        edges = np.flatnonzero(np.diff(np.concatenate(([0], codes >= 0, [0]))))
        begins, ends = edges[::2], edges[1::2]
        long = ends - begins >= self.shortest
        ranges: list[tuple[int, int]] = []
        found: set = set()
        for begin, end in zip(begins[long].tolist(), ends[long].tolist()):
            self._stream(codes[begin:end].tolist(), begin, ranges, found)
        return ranges, found

    def _stream(self, codes: list[int], offset: int, ranges: list, found: set) -> None:
        nexts, link, length, window = self.next, self.link, self.length, self.window
        state = matched = 0
        for place, code in enumerate(codes, offset + 1):
            while state and code not in nexts[state]:
                state = link[state]
                matched = length[state]
            if code in nexts[state]:
                state, matched = nexts[state][code], matched + 1
            reach = 0
            if matched >= window:
                reach = window
                found |= self.items[self._holding(state, window)]
            ending = self.ending[state]
            while ending > 0:
                for size, item in self.short[ending]:
                    if size <= matched:
                        reach = max(reach, size)
                        found.add(item)
                ending = self.ending[link[ending]]
            if reach:
                begin = place - reach
                while ranges and ranges[-1][1] >= begin:  # joined with what it touches
                    begin = min(begin, ranges.pop()[0])
                ranges.append((begin, place))


class Part:
    """Items of one automaton, built where it is first used; a worker holds the last one only."""

    built: dict[str, SuffixAutomaton] = CACHES.setdefault(__name__, {})

    def __init__(self, spark: SparkSession, items: list[tuple[object, str | None]], window: int):
        self.name, self.window = uuid.uuid4().hex, window
        self.items = spark.sparkContext.broadcast(items)

    def automaton(self) -> SuffixAutomaton:
        if self.name not in Part.built:
            Part.built.clear()
            items = [(item, words_of(text)) for item, text in self.items.value]
            Part.built[self.name] = SuffixAutomaton(items, self.window)
        return Part.built[self.name]


def parts_of(
    items: DataFrame, window: int, id_column: str, text_column: str, words: int | None
) -> Iterator[Part]:
    """The items, equal rows once, in parts of about ``words`` words; at least one part."""
    words = words or AUTOMATON_WORDS
    word = F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    rows = items.select(F.col(id_column).alias("item"), F.col(text_column).alias("text")).distinct()
    total = rows.agg(F.sum(F.regexp_count("text", word))).first()[0] or 0
    count = max(1, -(-total // words))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(count))
    for number in range(count):
        own = rows.where(part == number).orderBy("item", "text").collect()
        yield Part(items.sparkSession, [(row.item, row.text) for row in own], window)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges; overlapping and touching ones joined."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(ranges):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def scanned(docs: DataFrame, part: Part, id_column: str, text_column: str) -> DataFrame:
    """id, a, b (a digest of the text), n_words, ranges (begin, end, …) and items of every row."""

    def measure(batch: pa.RecordBatch) -> dict:
        automaton = part.automaton()
        n_words, ranges, items = [], [], []
        for text in batch.column(3).to_pylist():
            words = words_of(text)
            hit, found = automaton.hits(words)
            n_words.append(len(words))
            ranges.append([x for r in hit for x in r])
            items.append(sorted("" if i is None else str(i) for i in found))
        return {
            "id": batch.column(0), "a": batch.column(1), "b": batch.column(2),
            "n_words": pa.array(n_words, pa.int64()),
            "ranges": pa.array(ranges, pa.list_(pa.int64())),
            "items": pa.array(items, pa.list_(pa.string())),
        }

    text = F.col(text_column)
    keyed = docs.select(
        F.col(id_column).alias("id"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"), text
    )
    kind = docs.schema[id_column].dataType.simpleString()
    return map_arrow(
        keyed, measure, f"id {kind}, a long, b long, n_words long, ranges array<bigint>, items array<string>"
    )


def found_in(
    docs: DataFrame, parts: Iterator[Part], id_column: str, text_column: str
) -> DataFrame:
    """What ``scanned`` finds with all parts, one after the other.

    With several, only rows with hits are kept of each scan, and ranges and items meet by id and
    digest of the text: equal rows have equal hits.
    """
    first, others = next(parts), list(parts)
    rows = scanned(docs, first, id_column, text_column)
    if not others:
        return rows
    hit = F.size("ranges") > 0
    rows = shared_table(rows, "hits")
    more = [shared_table(scanned(docs, part, id_column, text_column).where(hit), "hits") for part in others]
    every = rows.where(hit)
    for one in more:
        every = every.unionByName(one)
    every = every.dropDuplicates(["id", "a", "b", "ranges", "items"])

    def merge(batch: pa.RecordBatch) -> dict:
        ranges = []
        for lists in batch.column(3).to_pylist():
            pairs = [pair for own in lists for pair in zip(own[::2], own[1::2])]
            ranges.append([x for pair in merged(pairs) for x in pair])
        return {
            "id": batch.column(0), "a": batch.column(1), "b": batch.column(2),
            "all_ranges": pa.array(ranges, pa.list_(pa.int64())), "all_items": batch.column(4),
        }

    lists = every.groupBy("id", "a", "b").agg(
        F.collect_list("ranges").alias("ranges"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    whole = map_arrow(
        lists, merge, f"id {kind}, a long, b long, all_ranges array<bigint>, all_items array<string>"
    ).toDF("_id", "_a", "_b", "all_ranges", "all_items")
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))
    return rows.join(whole, same, "left").select(
        "id", "a", "b", "n_words",
        F.coalesce("all_ranges", "ranges").alias("ranges"), F.coalesce("all_items", "items").alias("items"),
    )


def without(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without the hit words and what stands between them."""
    data = text.encode()
    spans = [m.span() for m in WORD.finditer(data.translate(TO_WORDS))]
    kept, at = [], 0
    for begin, end in ranges:
        kept.append(data[at : spans[begin][0]])
        at = spans[end - 1][1]
    kept.append(data[at:])
    return b"".join(kept).decode()


def contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    part_words: int | None = None,
) -> DataFrame:
    """id, n_words, n_hit, n_items, item_ids (sorted strings, comma-joined), hit_ranges.

    Words are runs of digits, letters a-z (upper case made lower) and non-ASCII characters.
    A window is ``window`` consecutive words of an item; a shorter item is one window. Null and
    empty texts have no words and no hits; without items nothing is hit. Items with equal ids
    count once, and one without an id has an empty name. Every row gives a row, also equal ones;
    other columns are not read.
    """
    parts = parts_of(items, window, item_column, item_text, part_words)
    found = found_in(docs, parts, id_column, text_column)
    lengths = F.aggregate(
        F.sequence(F.lit(0), F.size("ranges") - 1, F.lit(2)), F.lit(0).cast("long"),
        lambda total, i: total + F.get("ranges", i + 1) - F.get("ranges", i),
    )
    return found.select(
        F.col("id").alias(id_column),
        "n_words",
        F.when(F.size("ranges") > 0, lengths).otherwise(0).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.array_join("items", ",").alias("item_ids"),
        F.col("ranges").alias("hit_ranges"),
    )


def remove_spans(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    max_coverage: float = MAX_COVERAGE,
    text_column: str = "text",
    chars_column: str = "n_chars",
    id_column: str = "doc_id",
    part_words: int | None = None,
) -> DataFrame:
    """The documents, all columns, without hit spans.

    Documents with more than ``max_coverage`` of their words hit are dropped; in the others the
    spans go and, where there is such a column, the number of characters follows. Clean
    documents, null and empty texts stay as they are. With items for one automaton the documents are
    read and cut in one scan; with more, the ranges are found first and joined to the documents.
    """
    place, width = docs.columns.index(text_column), len(docs.columns)
    chars = docs.columns.index(chars_column) if chars_column in docs.columns else None
    parts = parts_of(items, window, "item_id", "text", part_words)
    first, others = next(parts), list(parts)

    def clean(batches: Iterator[pa.RecordBatch], ranges_of) -> Iterator[pa.RecordBatch]:
        make_room(__name__)
        for batch in (part for whole in batches for part in slices(whole, place, SLICE_BYTES)):
            texts, keep = batch.column(place).to_pylist(), []
            sizes = batch.column(chars).to_pylist() if chars is not None else None
            for i, (text, words, ranges) in enumerate(ranges_of(batch, texts)):
                hit = sum(e - b for b, e in ranges)
                keep.append(hit <= max_coverage * words)
                if ranges and keep[-1]:
                    texts[i] = without(text, ranges)
                    if sizes is not None:
                        sizes[i] = len(texts[i])
            columns = list(batch.columns)[:width]
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            if sizes is not None:
                columns[chars] = pa.array(sizes, batch.schema.field(chars).type)
            fields = pa.schema([batch.schema.field(i) for i in range(len(columns))])
            yield pa.RecordBatch.from_arrays(columns, schema=fields).filter(pa.array(keep))
        give_back()

    if not others:

        def streamed(batch: pa.RecordBatch, texts: list):
            automaton = first.automaton()
            for text in texts:
                words = words_of(text)
                yield text, len(words), automaton.hits(words)[0]

        return docs.mapInArrow(lambda batches: clean(batches, streamed), docs.schema)

    found = found_in(docs, iter([first, *others]), id_column, text_column).where(F.size("ranges") > 0)
    found = found.select("id", "a", "b", "n_words", "ranges").distinct()
    found = found.toDF("_id", "_a", "_b", "_words", "_ranges")
    text = F.col(text_column)
    same = (
        F.col(id_column).eqNullSafe(F.col("_id"))
        & (F.xxhash64(text) == F.col("_a"))
        & (F.xxhash64(F.lit(1), text) == F.col("_b"))
    )
    joined = docs.join(found, same, "left").select(*[docs[f"`{c}`"] for c in docs.columns], "_words", "_ranges")

    def known(batch: pa.RecordBatch, texts: list):
        columns = (batch.column(width + i).to_pylist() for i in (0, 1))
        for text, words, own in zip(texts, *columns):
            yield text, words or 0, list(zip(own[::2], own[1::2])) if own else []

    return joined.mapInArrow(lambda batches: clean(batches, known), docs.schema)


def benchmark_hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contamination of every document, with a digest of the items found."""
    found = contamination(docs, items)
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.col("item_ids"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
