"""Spelling variants: words one edit apart, found in bidirectional FM-indexes of the vocabulary.

Of two words with one code point inserted, deleted or replaced, one shares the other's first half as
its beginning or its second half as its end.

1. Words are counted over all texts.
2. The vocabulary is cut into ranges of about equal size, once by its words and once by the words
   read backwards, where a word's end is a beginning. A range is one shard, and has one index of
   its words, between delimiters. A word is asked for in the shards whose range holds words with its
   half; shards need not hold a whole beginning, so none is too large.
3. In a shard, the half is matched exactly, from the middle of the word out to the delimiter, with
   the suffix-rank intervals of the text and of its reverse kept in step. Then the search turns
   round and extends across the other half up to the next delimiter, with one error at any place.
4. Words found by both halves are counted by the first. A shard returns one row a word: how many
   words are near, and the most frequent. Forms lead on to roots by doubling.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from declarium.llm.common import map_arrow, shared_table, slices

# Words have at least so many code points and occurrences.
LEAST_LENGTH, LEAST_COUNT = 7, 2
# A form is at least so many times as frequent as its word.
FORM_TIMES = 10
# One run in so many loses a code point, if runs are garbled (see count_words).
GARBLED = 31
# Bytes of text searched at once; distinct words that a task counts before it passes them on.
SLICE_BYTES = 8 << 20
COUNTED = 300_000
# Characters of one shard's words, sampled words a shard, and characters of a splitter.
SHARD_CHARS = 1_000_000
SAMPLED = 32
SPLITTER_CHARS = 64
# Words searched together, by number and by characters.
ASKED, ASKED_CHARS = 4096, 4 << 20
# Intervals up to this size are read, for larger ones all symbols are tried.
READ = 64
BLOCK = 128

# In ISO 8859-1 every code point of a word is one byte, and other code points become "?".
CHARSET = "latin-1"
RUN = re.compile(rb"[a-z\xc0-\xff]{%d,}" % LEAST_LENGTH)
# Symbols: the delimiter, a to z, U+00C0 to U+00FF; in the order of their code points.
SYMBOLS = 1 + 26 + 64
SYMBOL = np.zeros(256, np.int64)
SYMBOL[ord("a") : ord("z") + 1] = np.arange(1, 27)
SYMBOL[0xC0:] = np.arange(27, SYMBOLS)


def count_words(
    docs: DataFrame, garbled: bool = False, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(word, n) of the words in all texts, A-Z in lower case.

    With ``garbled``, a run whose CRC-32 of "id:run" GARBLED divides loses the code point at
    that value modulo its length; runs of rows without an id lose none.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                for doc, text in zip(*(column.to_pylist() for column in part.columns)):
                    if not text:
                        continue
                    found = Counter(RUN.findall(text.encode(CHARSET, "replace").lower()))
                    if not garbled or doc is None:
                        counts.update(found)
                    else:
                        start = zlib.crc32(b"%d:" % doc)
                        for run, n in found.items():
                            counts[garble(run, start)] += n
                    if len(counts) > COUNTED:
                        yield passed(counts)
        if counts:
            yield passed(counts)

    def passed(counts: Counter) -> pa.RecordBatch:
        words = [word.decode(CHARSET) for word in counts]
        out = pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"]
        )
        counts.clear()
        return out

    counted = docs.select(id_column, text_column).mapInArrow(count, "word string, n long")
    return (
        counted.where(F.length("word") >= LEAST_LENGTH)
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= LEAST_COUNT)
    )


def garble(run: bytes, start: int) -> bytes:
    h = zlib.crc32(run if run.isascii() else run.decode(CHARSET).encode(), start)
    if h % GARBLED:
        return run
    place = h % len(run)
    return run[:place] + run[place + 1 :]


class Ranks:
    """The Burrows-Wheeler transform of a circular text, and its suffix ranks."""

    def __init__(self, text: np.ndarray) -> None:
        size = self.size = len(text)
        # sort by eight symbols, then by twice as many in every round
        rank, reach = text.copy(), 1
        while reach < 8:
            rank = rank * SYMBOLS**reach + np.roll(rank, -reach)
            reach *= 2
        rank = np.unique(rank, return_inverse=True)[1]
        while rank.max() < size - 1:
            rank = np.unique(rank * size + np.roll(rank, -reach), return_inverse=True)[1]
            reach *= 2
        self.places = np.empty(size, np.int64)
        self.places[rank] = np.arange(size)
        self.last = text[self.places - 1]
        order = np.argsort(self.last, kind="stable")
        self.keys = self.last[order] * size + order
        blocks = size // BLOCK + 1
        seen = np.bincount(np.arange(size) // BLOCK * SYMBOLS + self.last, minlength=blocks * SYMBOLS)
        before = np.cumsum(seen.reshape(blocks, SYMBOLS), axis=0) - seen.reshape(blocks, SYMBOLS)
        self.before = np.cumsum(before, axis=1) - before  # symbols below a symbol, before a block
        self.padded = np.concatenate([self.last, np.full(BLOCK, SYMBOLS)]).astype(np.uint8)

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The rank of ``symbol`` before a bound of suffix ranks."""
        return np.searchsorted(self.keys, symbol * self.size + at)

    def smaller(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many symbols of the transform before ``at`` are smaller."""
        block, inside = np.divmod(at, BLOCK)
        row = self.padded[np.minimum(block[:, None] * BLOCK + np.arange(BLOCK), len(self.padded) - 1)]
        row = (row < symbol[:, None]) & (np.arange(BLOCK) < inside[:, None])
        return self.before[block, symbol] + row.sum(axis=1)


class Index:
    """A bidirectional FM-index of distinct words in ascending order, each after a delimiter."""

    def __init__(self, words: list[bytes]) -> None:
        self.words = words
        text = SYMBOL[np.frombuffer(b"#" + b"#".join(words), np.uint8)]
        self.text, self.reverse = Ranks(text), Ranks(text[::-1].copy())
        self.delimiters = np.flatnonzero(text == 0)

    def halves(self, asked: "Asked") -> np.ndarray:
        """Intervals [low, high) of the reverse, for the delimiter and the exact part of each word.

        Symbols are put before the part, from its last one to the delimiter; the reverse's
        interval follows by the number of smaller symbols that could have been put there.
        """
        count = len(asked.parts)
        low, high = np.zeros(count, np.int64), np.full(count, self.text.size)
        back = low.copy()
        live = np.arange(count)
        for done in range(int(asked.parts.max()) + 1):
            live = live[(asked.parts[live] >= done) & (high[live] > low[live])]
            left = asked.parts[live] - 1 - done
            symbol = np.where(left >= 0, asked.flat[asked.starts[live] + np.maximum(left, 0)], 0)
            smaller = self.text.smaller(symbol, high[live]) - self.text.smaller(symbol, low[live])
            back[live] += smaller
            low[live] = self.text.step(symbol, low[live])
            high[live] = self.text.step(symbol, high[live])
        return np.stack([back, back + np.maximum(high - low, 0)])

    def near(self, asked: "Asked") -> tuple[np.ndarray, np.ndarray]:
        """(asked word, found word): one edit apart, the edit behind the exact part.

        Of equal ways to one word only one is gone: in a run of one letter, the last one is
        deleted, and a letter is inserted at its end.
        """
        ranks, found = self.reverse, []
        low, high = self.halves(asked)
        who = np.flatnonzero(high > low)
        low, high, place = low[who], high[who], asked.parts[who]
        wrong = np.zeros(len(who), bool)
        while len(who):
            size, own = asked.sizes[who], asked.symbol(who, place)
            next_who, next_place, next_wrong, next_low, next_high = [], [], [], [], []

            def go(chosen, symbol, places, errors):
                a, b = ranks.step(symbol, low[chosen]), ranks.step(symbol, high[chosen])
                some = b > a
                next_who.append(who[chosen][some])
                next_place.append(places[some])
                next_wrong.append(np.full(some.sum(), errors))
                next_low.append(a[some])
                next_high.append(b[some])

            # after the error: the word to its end, then the delimiter
            end = np.flatnonzero(wrong & (place == size))
            found.append(self.ended(who[end], low[end], high[end]))
            same = np.flatnonzero(wrong & (place < size))
            go(same, own[same], place[same] + 1, True)
            # no error yet: no error here
            right = np.flatnonzero(~wrong)
            same = right[place[right] < size[right]]
            go(same, own[same], place[same] + 1, False)
            # a symbol deleted, which reads nothing: so the next one, or the delimiter, is read
            following = asked.symbol(who, place + 1)
            gone = same[following[same] != own[same]]
            end = gone[place[gone] + 1 == size[gone]]
            found.append(self.ended(who[end], low[end], high[end]))
            more = gone[place[gone] + 1 < size[gone]]
            go(more, following[more], place[more] + 2, True)
            # another symbol in its place, or before it
            state, symbol = self.branches(low[right], high[right])
            state = right[state]
            other = (symbol > 0) & (symbol != own[state])
            state, symbol = state[other], symbol[other]
            go(state, symbol, place[state], True)
            replaced = place[state] < size[state]
            go(state[replaced], symbol[replaced], place[state][replaced] + 1, True)

            who, place = np.concatenate(next_who), np.concatenate(next_place)
            wrong = np.concatenate(next_wrong).astype(bool)
            low, high = np.concatenate(next_low), np.concatenate(next_high)
        return tuple(np.concatenate(part) for part in zip(*found)) if found else (who, who)

    def branches(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, symbol) that may follow in each interval."""
        sizes = high - low
        few, many = np.flatnonzero(sizes <= READ), np.flatnonzero(sizes > READ)
        state = np.repeat(few, sizes[few])
        starts = np.cumsum(sizes[few]) - sizes[few]
        rows = np.arange(len(state)) + np.repeat(low[few] - starts, sizes[few])
        seen = np.unique(state * SYMBOLS + self.reverse.last[rows])
        tried = (many[:, None] * SYMBOLS + np.arange(1, SYMBOLS)).ravel()
        return np.divmod(np.concatenate([seen, tried]), SYMBOLS)

    def ended(self, who: np.ndarray, low: np.ndarray, high: np.ndarray):
        """The words that end here: their delimiter's place tells which."""
        zero = np.zeros(len(who), np.int64)
        a, b = self.reverse.step(zero, low), self.reverse.step(zero, high)
        some = b > a  # words are distinct, so one at most
        place = self.reverse.size - 1 - self.reverse.places[a[some]]
        number = np.searchsorted(self.delimiters, place) - 1
        return who[some], number % len(self.words)


class Asked:
    """Words to search for, with how many of their first symbols must match."""

    def __init__(self, words: list[bytes], parts: list[int]) -> None:
        self.words = words
        self.parts = np.array(parts, np.int64)
        self.sizes = np.array([len(word) for word in words], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = SYMBOL[np.frombuffer(b"".join(words), np.uint8)]

    def symbol(self, who: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The symbol at a place; -1 behind the end."""
        inside = place < self.sizes[who]
        at = np.where(inside, self.starts[who] + place, 0)
        return np.where(inside, self.flat[at], -1)


def exact_part(size: int, side: int) -> int:
    """Symbols of the half that matches exactly: the first one, or (side 1) the second one."""
    return size - size // 2 if side else size // 2


def after(beginning: bytes) -> bytes | None:
    """The smallest string behind all that begin so."""
    kept = beginning.rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else None


def splitters(words: DataFrame, shards: int, count: int) -> list[list[bytes]]:
    """Places that cut the words, and the words read backwards, into ranges of about equal size.

    From a sample by hash of SAMPLED words a shard, each cut to SPLITTER_CHARS; any places give
    the same result.
    """
    share = min(1.0, SAMPLED * shards / max(count, 1))
    sample = words.where(
        F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    )
    cut = f"substring({{}}, 1, {SPLITTER_CHARS})"
    rows = sample.select(
        F.expr(cut.format("word")).alias("word"),
        F.expr(cut.format("reverse(word)")).alias("back"),
        F.length("word").alias("size"),
    ).toArrow()
    sizes = rows.column("size").to_numpy()
    out = []
    for name in ("word", "back"):
        texts = [text.encode(CHARSET) for text in rows.column(name).to_pylist()]
        order = sorted(range(len(texts)), key=texts.__getitem__)
        ends = np.cumsum(sizes[order]) if order else np.zeros(0)
        marks = np.arange(1, shards) * (ends[-1] / shards) if order else []
        out.append(sorted({texts[order[i]] for i in np.searchsorted(ends, marks)}))
    return out


def near_words(words: DataFrame, shards: int | None = None) -> DataFrame:
    """(word, n_near, best_n, best): of every word that has near words in ``words`` (word, n)."""
    spark = words.sparkSession
    count, chars = words.agg(F.count("*"), F.sum(F.length("word") + 1)).first()
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(chars or 0) // SHARD_CHARS))
    places = splitters(words, shards or wanted, count)
    shared = spark.sparkContext.broadcast(places)
    first = len(places[0]) + 1  # shards of side 1 are numbered behind those of side 0
    total = first + len(places[1]) + 1

    def deal(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"shard": [], "asked": [], "word": [], "n": []}

        def put(shard: int, asked: bool, word: bytes, n: int) -> None:
            for values, value in zip(out.values(), (shard, asked, word, n)):
                values.append(value)

        for word, n in zip(*(column.to_pylist() for column in batch.columns)):
            for side, cuts in enumerate(shared.value):
                own = word[::-1] if side else word
                base = first * side
                put(base + bisect_right(cuts, own), False, own, n)
                part = own[: exact_part(len(own), side)]
                beyond = after(part)
                top = len(cuts) if beyond is None else bisect_left(cuts, beyond)
                for shard in range(bisect_right(cuts, part), top + 1):
                    put(base + shard, True, own, n)
        return {
            "shard": pa.array(out["shard"], pa.int32()), "asked": pa.array(out["asked"]),
            "size": pa.array([len(w) if a else 0 for a, w in zip(out["asked"], out["word"])], pa.int32()),
            "word": pa.array(out["word"], pa.binary()), "n": pa.array(out["n"], pa.int64()),
        }

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, counts, index, asked, chars = None, [], [], None, [], 0
        for batch in batches:
            for shard, ask, word, n in zip(*(column.to_pylist() for column in batch.columns)):
                if shard != now:
                    if asked:
                        yield answer(index, now >= first, asked)
                    now, held, counts, index, asked, chars = shard, [], [], None, [], 0
                if not ask:
                    held.append(word)
                    counts.append(n)
                elif held:
                    if index is None:
                        index = prepare(held, counts, now >= first)
                    asked.append(word)
                    chars += len(word)
                    if len(asked) >= ASKED or chars >= ASKED_CHARS:
                        yield answer(index, now >= first, asked)
                        asked, chars = [], 0
        if asked:
            yield answer(index, now >= first, asked)

    def prepare(held: list[bytes], counts: list[int], side: bool):
        """The index, the words' counts, and their places in the order of the words."""
        order = sorted(range(len(held)), key=lambda i: held[i][::-1]) if side else range(len(held))
        rank = np.empty(len(held), np.int64)
        rank[list(order)] = np.arange(len(held))
        return Index(held), np.array(counts, np.int64), rank

    def answer(prepared, side: bool, words: list[bytes]) -> pa.RecordBatch:
        index, counts, rank = prepared
        parts = [exact_part(len(word), side) for word in words]
        who, what = index.near(Asked(words, parts))
        if side:  # those that share the first half were found by it
            fresh = [
                not index.words[v].endswith(words[u][parts[u] :])
                for u, v in zip(who.tolist(), what.tolist())
            ]
            who, what = who[fresh], what[fresh]
        order = np.lexsort((rank[what], -counts[what], who))
        who, what = who[order], what[order]
        starts = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1]))[: len(who)])
        turn = (lambda word: word[::-1].decode(CHARSET)) if side else (lambda w: w.decode(CHARSET))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([turn(words[u]) for u in who[starts]], pa.string()),
                pa.array(np.diff(np.append(starts, len(who)))),
                pa.array(counts[what[starts]]),
                pa.array([turn(index.words[v]) for v in what[starts]], pa.string()),
            ],
            names=["word", "n_near", "best_n", "best"],
        )

    coded = words.select(F.encode("word", "ISO-8859-1").alias("word"), "n")
    dealt = map_arrow(coded, deal, "shard int, asked boolean, size int, word binary, n long")
    held = dealt.repartitionById(total, F.col("shard")).sortWithinPartitions(
        "shard", "asked", "size", "word"
    )
    found = held.select("shard", "asked", "word", "n").mapInArrow(
        search, "word string, n_near long, best_n long, best string"
    )
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return (
        found.groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), best.alias("top"))
        .select("word", "n_near", (-F.col("top.less")).alias("best_n"), F.col("top.best").alias("best"))
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last one that forms (word, form) lead to.

    Each round follows twice as many; counts grow tenfold with every form, so there are few.
    """
    reached = forms.select("word", F.col("form").alias("root"))
    while True:
        on = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = shared_table(
            reached.join(on, "root", "left").select(
                "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
            ),
            "roots",
        )
        reached = step.select("word", "root")
        if step.where("moved").isEmpty():
            return reached


def spelling_variants(
    docs: DataFrame,
    garbled: bool = False,
    shards: int | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the vocabulary.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF with A-Z in lower case, of at least
    LEAST_LENGTH code points and LEAST_COUNT occurrences (n) in all texts. Near words differ by one
    inserted, deleted or replaced code point. A word's form is its most frequent near word (of equal
    ones the first in code-point order), if that is FORM_TIMES as frequent; else it is null, as is
    form_n. The root is what forms lead to, or the word itself.

    Null and empty texts have no words; repeated rows count as often as they stand there; empty
    tables give no words. Only id and text are read. For ``garbled`` see count_words.
    """
    words = shared_table(count_words(docs, garbled, id_column, text_column), "words")
    near = near_words(words, shards)
    enough = F.col("best_n") >= FORM_TIMES * F.col("n")
    found = shared_table(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(enough, F.col("best")).alias("form"), F.when(enough, F.col("best_n")).alias("form_n"),
        ),
        "near",
    )
    last = roots(found.where("form is not null"))
    return found.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
