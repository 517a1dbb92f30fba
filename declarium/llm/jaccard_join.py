"""Exact near-duplicate groups: a grouped prefix join on five-word shingles.

Two sets with a Jaccard similarity of at least t share a shingle among their first
n - ceil(t n) + 1 ones in any order that all documents keep to. Here rare shingles come first, so
what many documents share hardly ever makes candidates.

1. Documents with equal sets are one class; classes with equal prefix and size one group.
2. Groups are joined through the shingles of their prefixes. Only shingles that at least two
   groups have leave this step.
3. Every group is verified against two centres of each of its shingles, and every class against
   the first of its group: pairs in proportion to the postings, however large a group of near
   copies is. What links makes components.
4. Under each shingle, classes of different components are still open. As long as there are
   many, every class is verified against two more centres of its shingles, and components are
   joined; then the open pairs whose sizes, places and parities allow the similarity are verified.
   Classes of one component need no more links. Parities: every shingle of a set turns over one
   of 512 bits. Bits that differ between two sets come from shingles that only one of them has,
   so their number bounds what both can share, before any set is fetched.

So no link between components is lost, and no group of copies is expanded into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from declarium.llm.common import give_back, make_room, map_arrow, shared_table, slices

SHINGLE = 5
# Similarity, in hundredths.
SIMILAR = 75
# Bytes of text shingled at once.
SLICE_BYTES = 4 << 20
# Shingles taken as frequent: those that reach a number of occurrences, which doubles from the
# least until there are no more of them than this (16 bytes each are broadcast).
FREQUENT = 1 << 20
LEAST_FREQUENT = 16
# A task counts this many shingles together, and reports those that occur this often.
COUNTED_AT_ONCE = 4_000_000
REPORTED = 2
# Postings that one task of the join holds.
TASK_POSTINGS = 4_000_000
# Groups whose postings are packed together: their numbers fit two bytes.
PACKED = 10_000
# Bits of a set's parities, in words of 64.
PARITY_BITS = 512
PARITIES = [f"p{i}" for i in range(PARITY_BITS // 64)]
# Bits of the filter on documents whose shingles are needed again: a fixed size; what passes by
# chance is dropped by the exact join after it.
FILTER_BITS = 1 << 26
# The same of the ids of rows that may go, whose words of 64 bits are joined by broadcast.
GONE_BITS = 1 << 24
# Rounds of step 4 with two new centres a shingle, before what is open is paired in full. Rounds
# end early once there are only a few open pairs for every posting.
TURNS = 1
PAIRS_PER_POSTING = 4

# Fixed odd multipliers of the words of a shingle.
MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
    np.uint64,
)


# Multipliers of a word's bytes by their place, odd and without a pattern; longer words are hashed alone.
WORD_BYTES = 64
BYTE_MULTIPLIERS = np.random.default_rng(20_240).integers(1, 2**63, WORD_BYTES, np.uint64) * np.uint64(2) + np.uint64(1)
# Bytes of words hashed at once.
HASHED_BYTES = 1 << 20
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
VALUES = np.where(BLANK, 0, np.arange(256) + 1).astype(np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: bytes times odd numbers by place, summed and mixed."""
    import xxhash

    out = np.empty(len(starts), np.uint64)
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + HASHED_BYTES, "right")))
        at, lengths = starts[low:high] - starts[low], ends[low:high] - starts[low:high]
        own = data[starts[low] : ends[high - 1]]
        word = np.zeros(len(own), np.int32)
        word[at[1:]] = 1
        place = np.arange(len(own), dtype=np.int32) - at.astype(np.int32)[np.cumsum(word, dtype=np.int32)]
        parts = VALUES[own] * BYTE_MULTIPLIERS[np.minimum(place, WORD_BYTES - 1)]
        out[low:high] = np.add.reduceat(parts, at) + lengths.astype(np.uint64)
        for i in np.flatnonzero(lengths > WORD_BYTES).tolist():
            out[low + i] = xxhash.xxh3_64_intdigest(own[at[i] : at[i] + lengths[i]].tobytes())
        low = high
    out ^= out >> np.uint64(32)
    out *= MULTIPLIERS[0]
    return out ^ (out >> np.uint64(29))


def shingle_lists(texts: pa.Array) -> list[np.ndarray]:
    """The distinct shingles of every text, as sorted 64-bit hashes.

    Words are what ASCII white space separates, with A-Z in lower case. Fewer than five words
    are one shingle; no words, as in null, none.
    """
    lower = pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.large_string())
    if not len(lower):
        return []
    _, offsets, buffer = lower.buffers()
    edges = np.frombuffer(offsets, np.int64)[lower.offset : lower.offset + len(lower) + 1]
    data = np.frombuffer(buffer, np.uint8)[edges[0] : edges[-1]] if buffer else np.empty(0, np.uint8)
    edges = edges - edges[0]
    blank = BLANK[data]
    # a word begins behind a blank or where its text does, and ends alike
    before, after = np.ones((2, len(data)), bool)
    before[1:], after[:-1] = blank[:-1], blank[1:]
    inside = edges[(edges > 0) & (edges < len(data))]
    before[inside], after[inside - 1] = True, True
    starts, ends = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1
    hashes = word_hashes(data, starts, ends)
    bounds = np.searchsorted(starts, edges).tolist()
    whole = joined_words(hashes, SHINGLE)
    out = []
    for low, high in zip(bounds, bounds[1:]):
        if high - low >= SHINGLE:
            out.append(np.unique(whole[low : high - SHINGLE + 1]))
        else:
            out.append(joined_words(hashes[low:high], high - low))
    return out


def joined_words(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for every run of ``width`` words."""
    count = len(hashes) - width + 1
    if not width or count < 1:
        return np.empty(0, np.uint64)
    total = np.full(count, width, np.uint64)
    for i in range(width):
        total += hashes[i : i + count] * MULTIPLIERS[i]
        total ^= total >> np.uint64(29)
    total *= MULTIPLIERS[0]
    return total ^ (total >> np.uint64(32))


def digest(values: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(values.tobytes())


def parities(values: np.ndarray) -> np.ndarray:
    """PARITY_BITS bits, each turned over by every shingle that falls on it, as signed words."""
    counts = np.bincount((values % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS)
    return np.packbits(counts.astype(np.uint8) & 1, bitorder="little").view("<i8")


def prefix_size(n: int, similar: int = SIMILAR) -> int:
    return n + similar * n // -100 + 1 if n else 0


def prefix(values: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], similar: int) -> np.ndarray:
    """The first shingles: those not frequent by hash, then the frequent ones, rarest first."""
    size = prefix_size(len(values), similar)
    known, counts = frequent
    if not len(known):
        return values[:size]
    places = np.minimum(np.searchsorted(known, values), len(known) - 1)
    often = known[places] == values
    rare = values[~often]
    if len(rare) >= size:
        return rare[:size]
    order = np.lexsort((values[often], counts[places[often]]))
    return np.concatenate([rare, values[often][order]])[:size]


def frequent_shingles(docs: DataFrame, id_column: str, text_column: str) -> tuple:
    """(hashes, counts) of frequent shingles, in order of hash, and the number of all shingles.

    They decide the order of shingles only; any order gives the same result.
    """

    def report(found: list[np.ndarray]) -> pa.RecordBatch:
        """Shingles seen more than once; the last row carries the number of all shingles."""
        values = np.concatenate(found)
        values.sort()
        edges = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
        times = np.diff(edges, append=len(values))
        often = times >= REPORTED
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.append(values[edges][often].view(np.int64), 0)),
                pa.array(np.append(times[often], 0)),
                pa.array(np.append(np.zeros(often.sum(), np.int64), len(values))),
            ],
            names=["token", "n", "total"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(__name__)
        found, held = [], 0
        for batch in batches:
            for part in slices(batch, 0, SLICE_BYTES):
                found += shingle_lists(part.column(0))
                held = sum(map(len, found))
                if held >= COUNTED_AT_ONCE:
                    yield report(found)
                    found, held = [], 0
        if held:
            yield report(found)
        found = None
        give_back()

    counted = docs.select(text_column).mapInArrow(count, "token long, n long, total long")
    sums = shared_table(
        counted.groupBy("token").agg(F.sum("n").alias("n"), F.sum("total").alias("total")),
        "shingles",
    )
    total = sums.agg(F.sum("total")).first()[0] or 0
    # the smallest power of two that leaves no more than FREQUENT of them
    power = F.floor(F.log2("n")).cast("int")
    sizes = sums.where("n > 0").groupBy(power.alias("power")).count().collect()
    sizes = {row.power: row["count"] for row in sizes}
    least = LEAST_FREQUENT
    while sum(n for p, n in sizes.items() if 2**p >= least) > FREQUENT:
        least *= 2
    often = sums.where(F.col("n") >= least).select("token", "n").toArrow()
    tokens = often.column("token").to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], often.column("n").to_numpy()[order], total


def features(docs: DataFrame, frequent, similar: int, id_column: str, text_column: str):
    """id, n, key (of the set), gkey (of prefix and size), prefix and parities of every row."""

    def describe(batch: pa.RecordBatch) -> dict:
        out = {name: [] for name in ("n", "key", "gkey", "prefix")}
        bits = []
        for part in slices(batch, 1, SLICE_BYTES):
            for values in shingle_lists(part.column(1)):
                first = prefix(values, frequent.value, similar)
                out["n"].append(len(values))
                out["key"].append(digest(values))
                out["gkey"].append(digest(np.append(first, np.uint64(len(values)))))
                out["prefix"].append(first.tobytes())
                bits.append(parities(values))
        columns = {n: pa.array(v, pa.binary()) for n, v in out.items() if n != "n"}
        words = np.array(bits, np.int64).reshape(-1, len(PARITIES))
        columns |= {name: pa.array(words[:, i]) for i, name in enumerate(PARITIES)}
        return {id_column: batch.column(0), "n": pa.array(out["n"], pa.int64()), **columns}

    kind = docs.schema[id_column].dataType.simpleString()
    return map_arrow(
        docs.select(id_column, text_column),
        describe,
        f"{id_column} {kind}, n long, key binary, gkey binary, prefix binary, "
        + ", ".join(f"{name} long" for name in PARITIES),
    )


def postings(described: DataFrame, frequent, total: int) -> DataFrame:
    """(token, gkey, n, place) for the prefix shingles that at least two groups have.

    Tokens travel packed, many to a row, to the task of their hash. Frequent ones are known to
    be shared: they need not meet, and are dealt by group, so none gathers in one task.
    """
    spark = described.sparkSession
    tasks = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // 4 // TASK_POSTINGS)
    )
    buckets = 8 * tasks

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(__name__)
        known = frequent.value[0]
        for batch in parts(batches):
            groups = {
                g: (p, n)
                for g, p, n in zip(*(batch.column(c).to_pylist() for c in ("gkey", "prefix", "n")))
                if n
            }
            if not groups:
                continue
            tokens = [np.frombuffer(p, np.uint64) for p, _ in groups.values()]
            owner = np.repeat(np.arange(len(tokens), dtype=np.uint32), [len(t) for t in tokens])
            # places are lower bounds, so those beyond 65,535 may count as that
            place = [np.minimum(np.arange(len(t)), 65_535).astype(np.uint16) for t in tokens]
            place = np.concatenate(place)
            tokens = np.concatenate(tokens)
            names = np.frombuffer(b"".join(groups), "S16")
            sizes = np.array([n for _, n in groups.values()], np.int64)
            often = np.zeros(len(tokens), bool)
            if len(known):
                places = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                often = known[places] == tokens
            mixed = tokens * MULTIPLIERS[1]
            own = np.frombuffer(b"".join(groups), np.uint64)[::2][owner]
            bucket = (np.where(often, own, mixed) >> np.uint64(33)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            for at in np.split(order, cuts):
                used, index = np.unique(owner[at], return_inverse=True)  # at most PACKED
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(bucket[at[0]])], pa.int32()),
                        pa.array([tokens[at].tobytes()], pa.binary()),
                        pa.array([often[at].tobytes()], pa.binary()),
                        pa.array([index.astype(np.uint16).tobytes()], pa.binary()),
                        pa.array([place[at].tobytes()], pa.binary()),
                        pa.array([names[used].tobytes()], pa.binary()),
                        pa.array([sizes[used].tobytes()], pa.binary()),
                    ],
                    names=["bucket", "tokens", "often", "owner", "places", "names", "sizes"],
                )
        give_back()

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, PACKED):
                yield batch.slice(low, PACKED)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(__name__)
        columns: list[list[np.ndarray]] = [[], [], [], [], [], []]
        held = 0
        for batch in batches:
            kinds = (np.uint64, bool, np.uint16, np.uint16, "S16", np.int64)
            for row in range(batch.num_rows):
                found = [
                    np.frombuffer(batch.column(c + 1)[row].as_py(), kind)
                    for c, kind in enumerate(kinds)
                ]
                found[2] = found[2].astype(np.int64) + held
                held += len(found[4])
                for column, values in zip(columns, found):
                    column.append(values)
        if not held:
            return
        tokens, often, owner, place, names, sizes = map(np.concatenate, columns)
        columns.clear()
        _, group = np.unique(names, return_inverse=True)  # copies of a group came from many tasks
        order = np.lexsort((group[owner], tokens))
        tokens, often, owner, place = tokens[order], often[order], owner[order], place[order]
        first = np.ones(len(tokens), bool)
        first[1:] = (tokens[1:] != tokens[:-1]) | (group[owner[1:]] != group[owner[:-1]])
        tokens, often, owner, place = tokens[first], often[first], owner[first], place[first]
        same = np.zeros(len(tokens) + 1, bool)
        same[1:-1] = tokens[1:] == tokens[:-1]
        keep = np.flatnonzero(same[:-1] | same[1:] | often)
        for low in range(0, len(keep), 100_000):
            at = keep[low : low + 100_000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(tokens[at].view(np.int64)),
                    pa.array([names[i].ljust(16, b"\0") for i in owner[at]], pa.binary()),
                    pa.array(sizes[owner[at]]),
                    pa.array(place[at].astype(np.int32)),
                ],
                names=["token", "gkey", "n", "place"],
            )
        del tokens, often, owner, place, names, sizes, group, order, first, same, keep
        give_back()

    dealt = described.select("gkey", "prefix", "n").mapInArrow(
        deal,
        "bucket int, tokens binary, often binary, owner binary, places binary, names binary, "
        "sizes binary",
    )
    # copies of a group come to the same task for every token, and are one there
    return dealt.repartition(tasks, "bucket").mapInArrow(
        meet, "token long, gkey binary, n long, place int"
    )


def near(similar: int, a: str = "a", b: str = "b"):
    """Sizes that allow the similarity."""
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return 100 * small >= similar * large


def alike(a: str, b: str, similar: int):
    """Parities that allow the similarity.

    Of all shingles of both sets, two for each shared one must be left when those that the parities
    tell apart are gone.
    """
    apart = sum(F.bit_count(F.col(f"{a}.{p}").bitwiseXOR(F.col(f"{b}.{p}"))) for p in PARITIES)
    sizes = F.col(f"{a}.n") + F.col(f"{b}.n")
    return sizes - apart >= 2 * needed(F.col(f"{a}.n"), F.col(f"{b}.n"), similar)


def ordered_pairs(pairs: DataFrame) -> DataFrame:
    """Distinct (a, b) with a < b."""
    return (
        pairs.where("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_column: str, text_column: str):
    """(key, shingles) of wanted classes (key, doc), each from one of its documents.

    A bit set of hashed ids tells in the scan which texts to shingle, so texts are not shuffled.
    """
    spark = docs.sparkSession
    place = F.pmod(F.xxhash64("doc"), F.lit(FILTER_BITS))
    words = (
        wanted.select((place / 64).cast("long").alias("word"), (place % 64).cast("int").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
        .toArrow()
    )
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(bits)

    def sets(batch: pa.RecordBatch) -> dict | None:
        at = batch.column(0).to_numpy().astype(np.uint64)
        chosen = (shared.value[at // np.uint64(64)] >> (at % np.uint64(64))) & np.uint64(1) == 1
        if not chosen.any():
            return None
        wanted = pa.RecordBatch.from_arrays([batch.column(1).filter(pa.array(chosen))], names=["text"])
        found = [
            v for part in slices(wanted, 0, SLICE_BYTES) for v in shingle_lists(part.column(0)) if len(v)
        ]
        return {
            "key": pa.array([digest(v) for v in found], pa.binary()),
            "shingles": pa.array([v.tobytes() for v in found], pa.binary()),
        }

    named = docs.select(F.col(id_column).alias("doc"), F.col(text_column).alias("text"))
    made = map_arrow(named.select(place, "text"), sets, "key binary, shingles binary")
    return made.join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"])


def enough_shared(pairs: DataFrame, grouped: DataFrame, similar: int) -> DataFrame:
    """The group pairs (a, b) that share enough of their prefixes to be similar.

    What is shared in both prefixes, and all that one of them has beyond its prefix, bounds what
    is shared altogether. Shingles that only one group has are not in ``grouped``: (gkey, n,
    tokens).
    """
    left = grouped.select(F.col("gkey").alias("a"), F.struct("n", "tokens").alias("x"))
    right = grouped.select(F.col("gkey").alias("b"), F.struct("n", "tokens").alias("y"))
    beyond = F.ceil(F.greatest("x.n", "y.n") * similar / F.lit(100.0) - 1e-9) - 1
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .where(
            F.size(F.array_intersect("x.tokens", "y.tokens")) + beyond
            >= needed(F.col("x.n"), F.col("y.n"), similar)
        )
        .select("a", "b")
    )


def needed(m, n, similar: int):
    """Shingles that sets of two sizes must share to be similar."""
    return F.ceil(similar * (m + n) / F.lit(100.0 + similar) - 1e-9)


def verify(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """The pairs (a, b), with whether their similarity reaches the limit."""
    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("right"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")

    def compare(batch: pa.RecordBatch) -> dict:
        linked = []
        for left, right in zip(batch.column(2), batch.column(3)):
            x = np.frombuffer(left.as_buffer(), np.uint64)
            y = np.frombuffer(right.as_buffer(), np.uint64)
            places = np.minimum(np.searchsorted(y, x), len(y) - 1)
            shared = int((y[places] == x).sum())
            linked.append(100 * shared >= similar * (len(x) + len(y) - shared))
        return {"a": batch.column(0), "b": batch.column(1), "linked": pa.array(linked, pa.bool_())}

    return map_arrow(both, compare, "a binary, b binary, linked boolean")


def components(edges: DataFrame) -> DataFrame:
    """(key, component): the smallest key that edges (a, b) reach, for the keys in edges.

    Each round takes the smallest label around and then the label of that label, so a chain
    shortens to its half or less; each round's labels are written to the shared folder.
    """
    both = shared_table(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))),
        "edges",
    )
    labels = shared_table(
        both.groupBy(F.col("a").alias("key")).agg(
            F.least(F.min("b"), F.first("a")).alias("component")
        ),
        "labels",
    )
    while True:
        around = (
            both.join(labels.select(F.col("key").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("key"))
            .agg(F.min("component").alias("near"))
        )
        step = labels.join(around, "key").select(
            "key", F.col("component").alias("old"), F.least("component", "near").alias("component")
        )
        up = step.select(F.col("key").alias("component"), F.col("component").alias("up"))
        step = shared_table(
            step.join(up, "component").select("key", "old", F.col("up").alias("component")),
            "labels",
        )
        labels = step.select("key", "component")
        if step.where("old <> component").isEmpty():
            return labels


def classes_of(docs: DataFrame, similar: int, id_column: str, text_column: str) -> tuple:
    """Described rows (id, n, key) and, for every class, its component: (key, component)."""
    spark = docs.sparkSession
    tokens, counts, total = frequent_shingles(docs, id_column, text_column)
    frequent = spark.sparkContext.broadcast((tokens, counts))
    described = shared_table(
        features(docs, frequent, similar, id_column, text_column), "features"
    )
    posted = shared_table(postings(described, frequent, total), "postings")
    classes = shared_table(
        described.where("n > 0")
        .groupBy("key")
        .agg(
            F.first("gkey").alias("gkey"), F.first("n").alias("n"), F.min(id_column).alias("doc"),
            *(F.first(name).alias(name) for name in PARITIES),
        ),
        "classes",
    )
    firsts = classes.groupBy("gkey").agg(F.min("key").alias("rep"), F.count("key").alias("size"))

    # 3: two centres of every shingle, the first class of every group
    group = F.struct(F.xxhash64("gkey").alias("h"), "gkey", "n")
    centres = posted.groupBy("token").agg(F.min(group).alias("low"), F.max(group).alias("high"))
    ends = centres.select("token", F.explode(F.array("low", "high")).alias("c"))
    ends = ends.select("token", F.col("c.gkey").alias("centre"), F.col("c.n").alias("n"))
    stars = (
        posted.alias("a").join(ends.alias("b"), "token").where(near(similar))
        .select(F.col("a.gkey").alias("a"), F.col("b.centre").alias("b"))
    )
    reps = firsts.select("gkey", F.col("rep").alias("key")).join(classes.drop("gkey", "doc"), "key")
    reps = shared_table(reps, "reps")
    grouped = shared_table(
        posted.groupBy("gkey").agg(F.first("n").alias("n"), F.collect_list("token").alias("tokens")),
        "groups",
    )
    x = reps.select(F.col("gkey").alias("a"), F.struct("key", "n", *PARITIES).alias("x"))
    y = reps.select(F.col("gkey").alias("b"), F.struct("key", "n", *PARITIES).alias("y"))
    stars = (
        ordered_pairs(stars).join(x, "a").join(y, "b").where(alike("x", "y", similar))
        .select("a", "b", F.col("x.key").alias("x"), F.col("y.key").alias("y"))
    )
    enough = shared_table(stars, "alike")
    stars = enough_shared(enough.select("a", "b"), grouped, similar).join(enough, ["a", "b"])
    stars = stars.select(F.col("x").alias("a"), F.col("y").alias("b"))
    members = classes.join(firsts.where("size > 1"), "gkey").select(
        F.col("key").alias("a"), F.col("rep").alias("b")
    )
    pairs = shared_table(ordered_pairs(stars.union(members)), "stars")

    needs = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    sets = shared_table(
        shingle_sets(docs, classes.join(needs, "key", "left_semi"), id_column, text_column), "sets"
    )
    first_links = shared_table(verify(pairs, sets, similar).where("linked").select("a", "b"), "links")
    labels = components(first_links)

    # 4: what is still open between components
    edges, done = first_links, pairs
    for turn in range(TURNS + 1):
        listed, size = open_lists(posted, classes, firsts, labels)
        if not size[0]:
            break
        last = turn == TURNS or size[1] <= PAIRS_PER_POSTING * size[0]
        more = all_pairs(listed, similar) if last else star_pairs(listed, similar, turn)
        more = enough_between(more, grouped, similar)
        more = shared_table(more.join(done, ["a", "b"], "left_anti"), "open")
        if not more.isEmpty():
            keys = more.select(F.col("a").alias("key")).union(more.select("b")).distinct()
            missing = classes.join(keys, "key", "left_semi").join(sets, "key", "left_anti")
            missing = shared_table(missing.select("key", "doc"), "missing")
            if not missing.isEmpty():
                found = shingle_sets(docs, missing, id_column, text_column)
                sets = sets.union(shared_table(found, "sets"))
            found = verify(more, sets, similar).where("linked").select("a", "b")
            found = shared_table(found, "links")
            done = done.union(more)
            if not found.isEmpty():
                edges = edges.union(found)
                labels = components(edges)
        if last:
            break
    return described, classes, labels


def enough_between(pairs: DataFrame, grouped: DataFrame, similar: int) -> DataFrame:
    """Class pairs (a, b) out of (a, x, b, y) whose groups x and y are one or share enough."""
    pairs = shared_table(pairs, "candidates")
    flat = pairs.select("a", "b", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    groups = ordered_pairs(pairs.select(F.col("x").alias("a"), F.col("y").alias("b")))
    enough = enough_shared(groups, grouped, similar).toDF("x", "y")
    return (
        flat.where("x = y").select("a", "b").union(flat.join(enough, ["x", "y"]).select("a", "b"))
    )


def open_lists(posted, classes, firsts, labels) -> tuple:
    """(token, place, gkey, key, n, component, parities) under shingles of several components.

    A group of several classes is a list of its own; its classes share their whole prefix, so
    its place is 0. With it, how many postings there are and how many pairs they could make.
    """
    labelled = classes.join(labels, "key", "left").select(
        "gkey", "key", "n", F.coalesce("component", "key").alias("component"), *PARITIES
    )
    groups = labelled.join(firsts.where("size > 1").select("gkey"), "gkey", "left_semi")
    listed = (
        posted.select("token", "gkey", "place")
        .join(labelled, "gkey")
        .select("token", "place", "gkey", "key", "n", "component", *PARITIES)
        .union(
            groups.select(
                F.xxhash64("gkey", F.lit(1)), F.lit(0), "gkey", "key", "n", "component", *PARITIES
            )
        )
    )
    sums = listed.groupBy("token").agg(
        F.min("component").alias("x"), F.max("component").alias("y"), F.count("key").alias("m")
    )
    mixed = shared_table(sums.where("x <> y").select("token", "m"), "mixed")
    size = mixed.agg(F.sum("m"), F.sum(F.col("m") * (F.col("m") - 1))).first()
    return listed.join(mixed.select("token"), "token", "left_semi"), size


def star_pairs(listed: DataFrame, similar: int, turn: int) -> DataFrame:
    """Every class with two of its shingle's classes, others in every turn and shingle."""
    one = F.struct(
        F.xxhash64("key", "token", F.lit(turn)).alias("h"), "gkey", "key", "n", "component", "place",
        *PARITIES,
    )
    ends = listed.groupBy("token").agg(F.min(one).alias("low"), F.max(one).alias("high"))
    ends = ends.select("token", F.explode(F.array("low", "high")).alias("c")).select("token", "c.*")
    return joined_lists(listed, ends, similar, "a.component <> b.component")


def all_pairs(listed: DataFrame, similar: int) -> DataFrame:
    return joined_lists(listed, listed, similar, "a.component < b.component")


def joined_lists(left: DataFrame, right: DataFrame, similar: int, apart: str) -> DataFrame:
    """Pairs under one shingle whose sizes, places of the shingle and parities allow the similarity.

    The first shared shingle of a similar pair stands early in both: from there on, each must
    hold all that they share.
    """
    shared = needed(F.col("a.n"), F.col("b.n"), similar)
    early = (F.col("a.n") - F.col("a.place") >= shared) & (
        F.col("b.n") - F.col("b.place") >= shared
    )
    pairs = left.alias("a").join(right.alias("b"), "token").where(apart).where(near(similar))
    swap = F.col("a.key") > F.col("b.key")
    one, two = F.struct("a.key", "a.gkey"), F.struct("b.key", "b.gkey")
    return (
        pairs.where(early)
        .where(alike("a", "b", similar))
        .select(F.when(swap, two).otherwise(one).alias("p"), F.when(swap, one).otherwise(two).alias("q"))
        .select(
            F.col("p.key").alias("a"), F.col("p.gkey").alias("x"),
            F.col("q.key").alias("b"), F.col("q.gkey").alias("y"),
        )
        .distinct()
    )


def near_duplicates(
    docs: DataFrame,
    similar: int = SIMILAR,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """id, n_shingles and component_id (smallest id reachable by links) of every row.

    Two rows link when 100 * shared >= similar * united shingles. Null, empty and wordless texts
    have no shingles, link with nothing and are their own component; equal texts always link.
    Rows without an id take part, but name no component: that of rows without any id is null.
    Similarity is exact on 64-bit hashes of shingles. Only id and text are read.
    """
    described, classes, labels = classes_of(docs, similar, id_column, text_column)
    named = classes.join(labels, "key", "left").select(
        "key", "doc", F.coalesce("component", "key").alias("component")
    )
    smallest = named.groupBy("component").agg(F.min("doc").alias("component_id"))
    by_class = named.join(smallest, "component").select("key", "component_id")
    return described.join(by_class, "key", "left").select(
        id_column,
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id"))
        .otherwise(F.col(id_column))
        .alias("component_id"),
    )


def first_of_groups(docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """The documents, all columns, one of each group of near-duplicates: that of the smallest id.

    Texts without words are in no group, and stay. Ids that stand in several rows are told apart
    by their texts; of rows equal in both, one stays. A group without any id keeps one row.
    """
    described, classes, labels = classes_of(docs, similar, "doc_id", "text")
    named = classes.join(labels, "key", "left").select(
        "key", "doc", F.coalesce("component", "key").alias("component")
    )
    # struct order puts nulls first: a missing id only wins where there is no other
    first = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "key"))
    winners = named.groupBy("component").agg(first.alias("w")).select("w.doc", "w.key")
    wordless = described.where("n = 0").select("doc_id", "key")
    kept = shared_table(winners.union(wordless), "kept")
    counts = described.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    unclear = counts.where(F.col("doc_id").isNull() | (F.col("rows") > 1)).select("doc_id")
    unclear = shared_table(unclear, "unclear")
    # whole rows are shuffled only where their id may not be among those that stay as they are
    ids = kept.select(F.col("doc").alias("doc_id")).distinct()
    gone = described.select("doc_id").join(ids, "doc_id", "left_anti").union(unclear)
    sure, open_rows = parted(docs, gone, "doc_id")
    plain = sure.unionByName(open_rows.join(ids, "doc_id", "left_semi").join(unclear, "doc_id", "left_anti"))
    if unclear.isEmpty():
        return plain
    return plain.unionByName(_first_of_unclear(open_rows, unclear, kept))


def parted(docs: DataFrame, ids: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose id is surely not among ``ids``, and the others: all with such an id or none, and few more.

    A bit set of hashed ids tells in the scan, so no row is shuffled for it.
    """

    place = F.pmod(F.xxhash64(column), F.lit(GONE_BITS))
    marked = (
        ids.where(F.col(column).isNotNull())
        .select((place / 64).cast("long").alias("_gone_word"), (place % 64).cast("int").alias("bit"))
        .groupBy("_gone_word")
        .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("_gone_bits"))
    )
    marked = F.broadcast(shared_table(marked, "gone"))
    found = docs.join(marked, (place / 64).cast("long") == F.col("_gone_word"), "left")
    bit = F.getbit("_gone_bits", place % 64)
    hit = F.coalesce(bit == 1, F.lit(False)) | F.col(column).isNull()
    names = [F.col(f"`{name}`") for name in docs.columns]
    return found.where(~hit).select(names), found.where(hit).select(names)


def _first_of_unclear(docs: DataFrame, unclear: DataFrame, kept: DataFrame) -> DataFrame:
    u, k = unclear.select(F.col("doc_id").alias("u")), kept.alias("k")
    rows = docs.join(u, F.col("doc_id").eqNullSafe(F.col("u")), "left_semi")
    place, names = rows.columns.index("text"), [*rows.columns, "_key", "_empty"]

    def with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = slices(batch, place, SLICE_BYTES)
            found = [v for part in parts for v in shingle_lists(part.column(place))]
            keys = pa.array([digest(v) for v in found], pa.binary())
            empty = pa.array([not len(v) for v in found], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, keys, empty], names=names
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    keyed = rows.mapInArrow(with_key, f"{fields}, _key binary, _empty boolean")
    same = F.col("doc_id").eqNullSafe(F.col("k.doc")) & (F.col("_key") == F.col("k.key"))
    chosen = keyed.where("not _empty").join(k, same, "left_semi").dropDuplicates(["doc_id", "_key"])
    return chosen.unionByName(keyed.where("_empty")).drop("_key", "_empty")
