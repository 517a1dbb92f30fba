"""Toxicity scores of restored text.

Disguised words - look-alike signs, letters apart, letters repeated - are lattices of possible
characters. A Viterbi search under a character trigram model of all documents finds the likeliest
spellings (noisy channel); the restored words are scored by how surely they mark toxic documents.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from declarium.llm.common import held_out, map_arrow, slices

# Labelled documents that the word weights are learned from, at most: those with the smallest
# hashes of their ids. The character model counts every document.
SAMPLE = 20_000
# A word counts if it stands in this many toxic documents, and if, at this many standard errors
# below its estimate, it still marks a toxic document more likely than not.
LEAST_DOCS = 5
DEVIATIONS = 3.0
# Word beginnings that count as words: inflected forms share them.
BEGINNINGS = (4, 5, 6)
# Likeliest spellings of a disguised word that are scored.
SPELLINGS = 4
# Likeliest ways to part letters that stand apart into words that are scored.
PARTINGS = 16
# Readings of so many words are remembered; longer words are decoded each time.
LONGEST_REMEMBERED, REMEMBERED = 40, 200_000
SLICE_BYTES = 8 << 20

# What a sign may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b",
    "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i",
    "(": "c", "<": "c", "&": "a",
}
# Signs that may hide any vowel, or nothing.
MASKS = "*#%?"
VOWELS = "aeiou"
# Natural log probabilities of the channel.
KEPT, REPLACED, HIDDEN, DROPPED, LOST = 0.0, -0.5, -1.5, -0.3, -4.0

# Characters of the model: blank, a-z, the small Latin-1 letters, any other letter.
ALPHABET = " " + string.ascii_lowercase + "".join(map(chr, range(0xDF, 0x100)))
OTHER = len(ALPHABET)
SIZE = 64
CODES = {c: i for i, c in enumerate(ALPHABET)}

EDGES = string.punctuation + "¡¿«»“”‘’…–—"
SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
REPEATED = re.compile(r"(.)\1\1")
DECORATION = re.compile(r"^(\W)\1+|(\W)\2+$")


# -- the character model ----------------------------------------------------------------------


def code_table() -> np.ndarray:
    """Model codes by code point below 0x250; letters beyond are OTHER."""
    table = np.zeros(0x250, np.int64)
    for point in range(0x250):
        char = chr(point).lower()
        if char.isalpha():
            table[point] = CODES.get(char, OTHER)
    return table


def character_counts(docs: DataFrame, text_column: str = "text") -> np.ndarray:
    """Trigrams of all texts, blanks in between: SIZE x SIZE x SIZE counts.

    Counted in the tasks and summed in Spark; what reaches the driver is bounded by SIZE.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = code_table()
        sums = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            for part in slices(batch, 0, SLICE_BYTES):
                text = " ".join(t for t in part.column(0).to_pylist() if t)
                points = np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), "<u4")
                codes = np.where(points < 0x250, table[np.minimum(points, 0x24F)], OTHER)
                keep = np.ones(len(codes), bool)  # blanks in a row are one
                keep[1:] = (codes[1:] > 0) | (codes[:-1] > 0)
                codes = codes[keep]
                if len(codes) > 2:
                    grams = (codes[:-2] * SIZE + codes[1:-1]) * SIZE + codes[2:]
                    sums += np.bincount(grams, minlength=SIZE**3)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], ["gram", "n"])

    counted = docs.select(text_column).mapInArrow(count, "gram long, n long")
    found = counted.groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(SIZE**3)
    sums[found.column("gram").to_numpy()] = found.column("n").to_numpy()
    return sums.reshape(SIZE, SIZE, SIZE)


def log_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a b), trigrams mixed with bigrams, single characters and a floor."""

    def rates(table: np.ndarray) -> np.ndarray:
        return table / np.maximum(table.sum(axis=-1, keepdims=True), 1)

    mixed = (
        0.7 * rates(counts)
        + 0.2 * rates(counts.sum(axis=0))[None]
        + 0.09 * rates(counts.sum(axis=(0, 1)))[None, None]
        + 0.01 / SIZE
    )
    return np.log(mixed).astype(np.float32)


# -- decoding ---------------------------------------------------------------------------------


def places_of(char: str, times: int, inside: bool) -> list[tuple[str, float]]:
    """What a character that stands some times in a row may stand for, with log probabilities."""
    if char.isalpha():
        options = [(char * min(times, 2), KEPT if times < 3 else REPLACED)]
        if times > 1:
            options.append((char, KEPT if times > 2 else REPLACED))
        return options
    options = [(char, KEPT)] if char.isdigit() else []
    for other in LOOKALIKES.get(char, ""):
        options.append((other, REPLACED))
        if times > 1:
            options.append((other * 2, 2 * REPLACED))
    if char in MASKS and inside:
        options += [(v, HIDDEN) for v in VOWELS]
    if not char.isdigit():
        known = char in LOOKALIKES or char in MASKS
        options.append(("", LOST if known else DROPPED))
    return options


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For every place of a word the strings it may stand for, with their log probabilities."""
    return [
        places_of(run[1], len(run[0]), 0 < run.start() and run.end() < len(word))
        for run in re.finditer(r"(.)\1*", word, re.S)
    ]


def spaced_lattice(chars: list[str]) -> list[list[tuple[str, float]]]:
    """The lattice of single characters that stand apart: every second place is the white space
    in between, which ends a word or is nothing. Letters repeated more than twice may go."""
    places: list[list[tuple[str, float]]] = []
    for run in re.finditer(r"(.)\1*", "".join(chars), re.S):
        for at in range(run.start(), run.end()):
            options = places_of(run[1], 1, 0 < at < len(chars) - 1)
            if at > run.start() and len(run[0]) > 2 and run[1].isalpha():
                options.append(("", REPLACED))
            places += [options, [("", KEPT), (" ", KEPT)]]
    return places[:-1]


def decode(
    places: list[list[tuple[str, float]]], model: np.ndarray, most: int = SPELLINGS
) -> list[list[str]]:
    """The likeliest paths through a lattice, as the strings taken at its places: Viterbi over
    the last two characters, the best few of every state. Paths are linked backwards, so that
    time and memory grow with the number of places."""
    states: dict[tuple[int, int], list[tuple]] = {(0, 0): [(0.0, None, "")]}
    for options in places:
        reached: dict[tuple[int, int], list[tuple]] = {}
        for (a, b), paths in states.items():
            for piece, cost in options:
                x, y = a, b
                for char in piece:
                    code = CODES.get(char, OTHER)
                    cost += float(model[x, y, code])
                    x, y = y, code
                reached.setdefault((x, y), []).extend((p[0] + cost, p, piece) for p in paths)
        states = {k: sorted(v, key=SCORE, reverse=True)[:most] for k, v in reached.items()}
    ended = [(p[0] + float(model[a, b, 0]), p) for (a, b), v in states.items() for p in v]
    out = []
    for _, path in sorted(ended, key=SCORE, reverse=True)[:most]:
        pieces = []
        while path[1] is not None:
            pieces.append(path[2])
            path = path[1]
        out.append(pieces[::-1])
    return out


SCORE = itemgetter(0)


def spellings(word: str, model: np.ndarray, most: int = SPELLINGS) -> list[str]:
    """The likeliest readings of a word."""
    return list(dict.fromkeys("".join(p) for p in decode(lattice(word), model, most)))


class Restorer:
    """Words of texts as they are read: plain ones as they stand, others decoded."""

    def __init__(self, model: np.ndarray):
        self.model = model
        self.known: dict[str, list[str]] = {}

    def read(self, word: str) -> list[str]:
        """Readings of a word in lower case; none for what has no letter."""
        core = word.strip(EDGES)
        if core.isalpha() and core == word and not REPEATED.search(core):
            return [core]
        if len(word) > LONGEST_REMEMBERED:
            return self._decode(word, core)
        if word not in self.known:
            if len(self.known) > REMEMBERED:
                self.known = {}
            self.known[word] = self._decode(word, core)
        return self.known[word]

    def _decode(self, word: str, core: str) -> list[str]:
        if not any(map(str.isalpha, core)):
            return []
        found = [core]
        bare = word
        while (shorter := DECORATION.sub("", bare)) != bare:
            bare = shorter
        if not bare.isalpha() or REPEATED.search(bare):
            # what stands around a plain word is punctuation, unless it looks like a letter
            inner = bare.strip("".join(set(EDGES) - set("@$!|+(&")))
            if not inner.isalpha() or REPEATED.search(inner):
                found += spellings(inner, self.model)
        return list(dict.fromkeys(found))

    def segments(self, apart: str) -> list[list[str]]:
        """The likeliest ways to part single characters that stand apart into words, each as the
        words that they spell; none for what has no letter."""
        chars = apart.split()
        if not any(map(str.isalpha, chars)):
            return []
        return ["".join(p).split() for p in decode(spaced_lattice(chars), self.model, PARTINGS)]

    def words(self, text: str) -> set[str]:
        """All readings of the words of a text, letters that stand apart joined to words."""
        lower = text.lower()
        out: set[str] = set()
        for word in set(lower.split()):
            out.update(self.read(word))
        for apart in set(SPACED.findall(lower)):
            for found in self.segments(apart):
                for word in found:
                    out.update(self.read(word))
        return out

    def restore(self, text: str) -> str:
        """The text with every disguised word in its likeliest reading."""

        def best(word: str) -> str:
            readings = self.read(word.lower())  # the plain one first, then the likeliest
            return readings[1] if len(readings) > 1 else word

        def joined_words(match: re.Match) -> str:
            found = self.segments(match[0].lower())
            return " ".join(found[0]) if found else match[0]

        joined = SPACED.sub(joined_words, text)
        return re.sub(r"\S+", lambda m: best(m[0]), joined)


def marks(words: set[str]) -> set[str]:
    """What may mark a document: its words, and beginnings of words with a star after them."""
    out = set(words)
    for size in BEGINNINGS:
        out.update(w[:size] + "*" for w in words if len(w) >= size)
    return out


# -- learning and scoring ---------------------------------------------------------------------


def learn_weights(
    docs: DataFrame,
    labels: DataFrame,
    model: np.ndarray,
    sample: int = SAMPLE,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
) -> dict[str, float]:
    """For marks of toxic documents, a careful estimate of how surely they mark one.

    Learned outside the held-out fold. A document labelled more than once is toxic if one of its
    labels says so; null labels do not count. Estimates are Wilson lower bounds.
    """
    spark = docs.sparkSession
    chosen = (
        labels.where(F.col(label_column).isNotNull() & ~held_out(id_column))
        .groupBy(F.col(id_column).alias("doc_id"))
        .agg(F.max(F.col(label_column).cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    labelled = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).join(
        F.broadcast(chosen), "doc_id"  # at most ``sample`` rows
    )
    shared = spark.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Restorer(shared.value)
        clean, toxic = Counter(), Counter()
        for batch in batches:
            for text, label in zip(*(batch.column(c).to_pylist() for c in (0, 1))):
                if text:
                    (toxic if label else clean).update(marks(reader.words(text)))
        for side, found in ((0, clean), (1, toxic)):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(found), pa.string()),
                    pa.array([side] * len(found), pa.int32()),
                    pa.array(list(found.values()), pa.int64()),
                ],
                names=["mark", "toxic", "n"],
            )

    counted = (
        labelled.select("text", "toxic")
        .mapInArrow(count, "mark string, toxic int, n long")
        .groupBy("mark")
        .agg(F.sum(F.col("toxic") * F.col("n")).alias("toxic"), F.sum("n").alias("n"))
    )
    rate, n, z2 = F.col("toxic") / F.col("n"), F.col("n"), DEVIATIONS**2
    bound = (
        rate + z2 / (2 * n)
        - DEVIATIONS * F.sqrt(rate * (1 - rate) / n + z2 / (4 * n * n))
    ) / (1 + z2 / n)
    # at most ``sample`` x words rows, and far fewer in truth
    found = counted.where(F.col("toxic") >= LEAST_DOCS).select("mark", bound.alias("weight"))
    return {r.mark: r.weight for r in found.where(F.col("weight") >= 0.5).collect()}


def score_words(words: set[str], weights: dict[str, float]) -> float:
    """1 - the chance that no word marks the document as toxic; each word by its surest mark."""
    clean = 1.0
    for word in words:
        surest = max(
            weights.get(word, 0.0),
            *(weights.get(word[:size] + "*", 0.0) for size in BEGINNINGS if len(word) >= size),
            0.0,
        )
        clean *= 1 - surest
    return 1 - clean


def score_documents(
    docs: DataFrame,
    model: np.ndarray,
    weights: dict[str, float],
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """id, held_out, score, predicted of every row.

    Null, empty and wordless texts score 0, as does everything when nothing was learned. Equal
    rows give a row each; rows without an id count as held out. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, weights))
    held: list = []

    def measure(batch: pa.RecordBatch) -> dict:
        if not held:
            learned = shared.value[1]
            starts = {
                size: {m[:-1] for m in learned if m[-1:] == "*" and len(m) == size + 1}
                for size in BEGINNINGS
            }
            held.extend([Restorer(shared.value[0]), learned, starts])
        reader, learned, starts = held
        scores = []
        for text in batch.column(2).to_pylist():
            words = reader.words(text) if text else set()
            marked = words & learned.keys()
            for size, known in starts.items():
                marked.update(w for w in words if w[:size] in known)
            scores.append(score_words(marked, learned))
        return {
            id_column: batch.column(0),
            "held_out": batch.column(1),
            "score": pa.array(scores, pa.float64()),
            "predicted": pa.array([int(s >= 0.5) for s in scores], pa.int32()),
        }

    kind = docs.schema[id_column].dataType.simpleString()
    return map_arrow(
        docs.select(F.col(id_column), held_out(id_column).alias("held_out"), F.col(text_column)),
        measure,
        f"{id_column} {kind}, held_out boolean, score double, predicted int",
    )


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Count characters, learn weights on the learning folds, score every document."""
    model = log_model(character_counts(docs))
    return score_documents(docs, model, learn_weights(docs, labels, model))
