"""Language identification by rank-order n-gram profiles and out-of-place distance.

A language's profile is its most frequent character n-grams, by rank. A document's own most
frequent n-grams are ranked alike; its distance to a profile is the sum of the differences in
rank, an n-gram that the profile lacks counting as the profile's size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from declarium.llm.common import held_out, map_arrow, texts_of

# N-grams of a profile, of one to three characters.
PROFILE = 300
# Labelled documents of a language that the profiles are made from, on average: chosen by a
# hash of the id, the same ones whatever the order of the input.
SAMPLE = 2_000
# The learned label of texts that have no letters.
UNDECIDED = "und"
# keep_identified rejects documents below this share of the median score of their language.
# Texts of no learned language score about a third of it, with any profile.
FLOOR_SHARE = 0.5
# Steps of scores when medians are counted.
STEPS = 1_000


@cache
def letters() -> np.ndarray:
    """By code point, whether it is a letter."""
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """The n-grams of a text's words, in the order of their text, and how often each occurs.

    An n-gram of up to three characters is one number, 21 bits a character. Words have a blank
    on either side; n-grams never reach into the next word. None if there is no letter.
    """
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4")
    letter = letters()[points]
    if not letter.any():
        return None
    points = np.where(letter, points, 32).astype(np.int64) + 1
    one, two, three = points << 42, points << 21, points
    pairs = letter[:-1] | letter[1:]
    found = np.concatenate([
        one[letter],
        (one[:-1] | two[1:])[pairs],
        (one[:-2] | two[1:-1] | three[2:])[letter[1:-1]],
    ])
    found.sort()
    edges = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
    return found[edges], np.diff(edges, append=len(found))


def gram_text(gram: int) -> str:
    points = [gram >> shift & 0x1FFFFF for shift in (42, 21, 0)]
    return "".join(chr(p - 1) for p in points if p)


def learn_profiles(
    docs: DataFrame,
    sample: int = SAMPLE,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
) -> dict[str, list[int]]:
    """The ranked n-grams of every language outside the held-out fold.

    Counted in Spark over at most about ``sample`` documents a language; equal counts are
    ordered by the n-gram. The result is bounded by the number of languages.
    """
    labelled = docs.select(
        F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"),
        F.col(lang_column).alias("lang"),
    ).where(F.col("lang").isNotNull() & ~held_out("doc_id"))
    totals = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("_total"))
    share = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1_000_000)) / 1e6
    # one row a language, as in the result
    chosen = labelled.join(F.broadcast(totals), "lang").where(share * F.col("_total") < sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(texts_of(batch), texts_of(batch, "lang")):
                grams = ngrams(text) if text else None
                if grams is not None:
                    own = found.setdefault(lang, Counter())
                    for gram, n in zip(grams[0].tolist(), grams[1].tolist()):
                        own[gram] += n
        for lang, own in found.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(own), pa.string()),
                    pa.array(list(own), pa.int64()),
                    pa.array(list(own.values()), pa.int64()),
                ],
                names=["lang", "gram", "n"],
            )

    counted = (
        chosen.select("text", "lang")
        .mapInArrow(count, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    ranked = counted.withColumn("rank", place).where(F.col("rank") <= PROFILE)
    profiles: dict[str, list[int]] = {}
    for row in sorted(ranked.select("lang", "rank", "gram").collect()):
        profiles.setdefault(row.lang, []).append(row.gram)
    return profiles


class Identifier:
    def __init__(self, profiles: dict[str, list[int]]):
        self.languages = sorted(profiles)
        self.grams = np.array(sorted({g for p in profiles.values() for g in p}), np.int64)
        # ranks by n-gram and language; the last row is for n-grams of no profile
        self.ranks = np.full((len(self.grams) + 1, len(self.languages)), -1, np.int64)
        for column, lang in enumerate(self.languages):
            places = np.searchsorted(self.grams, np.array(profiles[lang], np.int64))
            self.ranks[places, column] = np.arange(len(places))

    def predict(self, text: str | None) -> tuple[str, float]:
        found = ngrams(text) if text else None
        if found is None or not self.languages:
            return UNDECIDED, 0.0
        grams, counts = found
        if len(grams) > PROFILE:
            least = np.partition(counts, -PROFILE)[-PROFILE]
            used = counts >= least
            grams, counts = grams[used], counts[used]
        # n-grams are in the order of their text, which decides between equal counts
        grams = grams[np.argsort(-counts, kind="stable")[:PROFILE]]
        places = np.searchsorted(self.grams, grams)
        places[self.grams[np.minimum(places, len(self.grams) - 1)] != grams] = len(self.grams)
        ranks = self.ranks[places]
        apart = np.abs(ranks - np.arange(len(grams))[:, None])
        distances = np.where(ranks < 0, PROFILE, np.minimum(apart, PROFILE)).sum(axis=0)
        best = int(distances.argmin())  # ties: the first language by name
        return self.languages[best], 1 - float(distances[best]) / (PROFILE * len(grams))


def identify(
    docs: DataFrame,
    profiles: dict[str, list[int]],
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """id, held_out, lang_pred, score (1 - distance / largest distance) of every row.

    Null, empty and letterless texts are ``und`` with score 0, as is everything when no language
    was learned. Equal distances go to the first language by name. Rows without an id count as
    held out. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # languages x PROFILE n-grams
    held: list[Identifier] = []

    def predict(batch: pa.RecordBatch) -> dict:
        if not held:
            held.append(Identifier(shared.value))
        found = [held[0].predict(text) for text in texts_of(batch, text_column)]
        return {
            id_column: batch.column(0),
            "held_out": batch.column(1),
            "lang_pred": pa.array([f[0] for f in found], pa.string()),
            "score": pa.array([f[1] for f in found], pa.float64()),
        }

    kind = docs.schema[id_column].dataType.simpleString()
    return map_arrow(
        docs.select(F.col(id_column), held_out(id_column).alias("held_out"), F.col(text_column)),
        predict,
        f"{id_column} {kind}, held_out boolean, lang_pred string, score double",
    )


def learn_floors(
    docs: DataFrame,
    profiles: dict[str, list[int]],
    share: float = FLOOR_SHARE,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
) -> dict[str, float]:
    """The least score of a document of every language: a share of the median score of all its
    labelled documents outside the held-out fold that are taken for it.

    The median is that of scores counted in STEPS, so it does not depend on the order of rows.
    A language that none of its documents is taken for has the least floor of the others.
    """
    labelled = docs.select(
        F.col(text_column).alias("text"), F.col(lang_column).alias("lang")
    ).where(F.col("lang").isNotNull() & ~held_out(id_column))
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, found = Identifier(shared.value), Counter()
        for batch in batches:
            for text, lang in zip(texts_of(batch), texts_of(batch, "lang")):
                taken, score = known.predict(text)
                if taken == lang:
                    found[lang, int(score * STEPS)] += 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang for lang, _ in found], pa.string()),
                pa.array([step for _, step in found], pa.int32()),
                pa.array(list(found.values()), pa.int64()),
            ],
            names=["lang", "step", "n"],
        )

    counted = (
        labelled.mapInArrow(count, "lang string, step int, n long")
        .groupBy("lang", "step")
        .agg(F.sum("n").alias("n"))
    )
    steps: dict[str, list[tuple[int, int]]] = {}
    for row in sorted(counted.collect()):  # at most languages x STEPS rows
        steps.setdefault(row.lang, []).append((row.step, row.n))
    floors = {}
    for lang, own in steps.items():
        above = np.cumsum([n for _, n in own])
        floors[lang] = share * own[int(np.searchsorted(above, above[-1] / 2))][0] / STEPS
    least = min(floors.values(), default=0.0)
    return {lang: floors.get(lang, least) for lang in profiles}


def keep_identified(
    docs: DataFrame, profiles: dict[str, list[int]], floors: dict[str, float] | None = None
) -> DataFrame:
    """Documents, all columns, whose text is in a learned language: score of at least its floor.

    Floors are learned from the documents if they are not given. Letterless, empty and null
    texts go, and so do noise and texts in languages that no label teaches.
    """
    floors = learn_floors(docs, profiles) if floors is None else floors
    shared = docs.sparkSession.sparkContext.broadcast((profiles, floors))
    place = docs.columns.index("text")
    held: list[Identifier] = []

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not held:
                held.append(Identifier(shared.value[0]))
            found = [held[0].predict(text) for text in batch.column(place).to_pylist()]
            least = shared.value[1]
            yield batch.filter(pa.array([l != UNDECIDED and s >= least[l] for l, s in found]))

    return docs.mapInArrow(keep, docs.schema)


def language_id(docs: DataFrame) -> DataFrame:
    """Learn on the learning folds, predict for every document."""
    return identify(docs, learn_profiles(docs))
