"""Near-duplicates by 64-bit SimHash: deletion variants of two segments, joined by equality.

A fingerprint is cut into two segments of 32 bits. Of two fingerprints that differ in at most three
bits, one segment differs in at most one. So each segment is indexed as it is, and once for each of
its bits with that bit left out: two fingerprints meet under the whole segment if they are equal
there, and under the variant without bit i if they differ in bit i alone.

1. Equal fingerprints are one class, so copies of a text are compared once.
2. Classes are dealt by variant to tasks. A task sorts what it got, and verifies those that meet.
   It passes on a spanning tree of the links under a variant, not all pairs.
3. A segment that very many fingerprints share would fill a task. Its members are cut again in the
   other segment: where up to three bits may differ, into the variants of two halves; where only
   two are left, into three parts, one of which is equal.
4. Components of the links give every document its group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from declarium.llm.common import give_back, make_room, map_arrow, shared_table, slices
from declarium.llm.jaccard_join import components

SHINGLE = 3
SEED = 42
# Bits in which linked fingerprints differ at most.
DISTANCE = 3
# Bytes of text, and shingles of a text, worked on at once.
SLICE_BYTES = 8 << 20
SHINGLES = 1 << 16
# Fingerprints dealt at once (11 KB each while their variants are made), and variants that one
# task holds (100 bytes each while they are compared).
DEALT = 1 << 13
TASK_VARIANTS = 500_000
# Segments with more members than this, or than 1 / HOT_SEGMENTS of all, are cut again; so the
# broadcast list of them has at most HOT_SEGMENTS entries.
HOT_MEMBERS = 50_000
HOT_SEGMENTS = 1 << 18
# Fingerprints with more documents than this, or than 1 / HOT_CLASSES of all, are joined to their
# documents by broadcast; there are at most HOT_CLASSES of them.
HOT_DOCUMENTS = 1_000
HOT_CLASSES = 10_000
# Groups up to this size are compared all at once, larger ones one by one.
SMALL = 16

BITS = 32
SEGMENT = np.uint64((1 << BITS) - 1)
# The variants of one segment: without bit 0, 1, … 31, and whole.
WHOLE = BITS
VARIANTS = BITS + 1
# What of the other segment is compared, where a segment is cut again.
THIRDS = [0x7FF, 0x7FF << 11, 0x3FF << 22]
HALVES = [
    (0xFFFF << at) & ~(1 << bit)
    for at in (0, 16)
    for bit in (*range(at, at + 16), BITS)  # BITS: no bit of the half
]
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)


def fingerprint(text: str | None) -> int:
    """A bit is 1 if more than half of the XXH64 values of the three-word shingles have it.

    Words are what ASCII white space separates, with A-Z in lower case; shingles count as often as
    they occur. Fewer than three words are one shingle; none, as in null, give zero.
    """
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined, width = b" ".join(words), min(len(words), SHINGLE)
    ends = np.cumsum([len(word) + 1 for word in words])
    starts = (ends - [len(word) + 1 for word in words])[: len(words) - width + 1].tolist()
    ends = (ends - 1)[width - 1 :].tolist()
    value, bits = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for low in range(0, len(starts), SHINGLES):
        places = zip(starts[low : low + SHINGLES], ends[low : low + SHINGLES])
        hashes = np.array([value(joined[a:b], SEED) for a, b in places], "<u8")
        rows = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bits += rows.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, fp) of every row; fp as a signed 64-bit number."""

    def describe(batch: pa.RecordBatch) -> dict:
        found = [
            fingerprint(text)
            for part in slices(batch, 1, SLICE_BYTES)
            for text in part.column(1).to_pylist()
        ]
        return {id_column: batch.column(0), "fp": pa.array(np.array(found, np.uint64).view(np.int64))}

    kind = docs.schema[id_column].dataType.simpleString()
    return map_arrow(docs.select(id_column, text_column), describe, f"{id_column} {kind}, fp long")


def segments(fps: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """The segment on a side (0: low bits), and the other one."""
    low, high = fps & SEGMENT, fps >> np.uint64(BITS)
    return (high, low) if side else (low, high)


def variant_keys(fps: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """A 64-bit key of each fingerprint's variant; what meets by chance is dropped by its distance.

    A code is (part * 2 + side) * VARIANTS + variant; part 0 has nothing of the other segment, part
    p what the p-th mask leaves.
    """
    rest, variant = np.divmod(codes.astype(np.int64), VARIANTS)
    part, side = np.divmod(rest, 2)
    low, high = segments(fps, 0)
    own, other = np.where(side, high, low), np.where(side, low, high)
    left_out = np.where(variant < WHOLE, np.uint64(1) << variant.astype(np.uint64), np.uint64(0))
    masks = np.where(
        variant < WHOLE,
        np.array([0, *THIRDS] + [0] * (len(HALVES) - len(THIRDS)), np.uint64)[part],
        np.array([0, *HALVES], np.uint64)[part],
    )
    key = ((own & ~left_out) | (codes.astype(np.uint64) << np.uint64(BITS))) * MIX[0]
    key ^= key >> np.uint64(29)
    key = (key + (other & masks) * MIX[1]) * MIX[2]
    return key ^ (key >> np.uint64(32))


def codes_of(fps: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the fingerprint, code) of all variants under which it is indexed."""
    places, codes, every = [], [], np.arange(len(fps))
    for side in (0, 1):
        own, _ = segments(fps, side)
        for variant in range(VARIANTS):
            both = (own, own ^ np.uint64(1 << variant)) if variant < WHOLE else (own,)
            again = np.zeros(len(fps), bool)
            for segment in both if len(hot[side]) else ():
                at = np.minimum(np.searchsorted(hot[side], segment), len(hot[side]) - 1)
                again |= hot[side][at] == segment
            masks = THIRDS if variant < WHOLE else HALVES
            for part in range(len(masks) + 1):
                chosen = every[again] if part else every[~again]
                places.append(chosen.astype(np.int32))
                codes.append(np.full(len(chosen), (part * 2 + side) * VARIANTS + variant, np.uint16))
    return np.concatenate(places), np.concatenate(codes)


def close_to(fp: np.uint64, others: np.ndarray) -> np.ndarray:
    return np.bitwise_count(others ^ fp) <= DISTANCE


def spanning_links(left: np.ndarray, right: np.ndarray | None) -> list[tuple[int, int]]:
    """Links that join what is linked among fingerprints, or across two sets of them.

    Every one reached looks only at those not reached yet: a cluster costs a few passes, and no
    more than one link for each member leaves it.
    """
    pools = [left] if right is None else [left, right]
    links, seeds = [], left
    while len(seeds):
        seed, pools[0] = seeds[0], pools[0][1:]
        ready = [(seed, 0)]
        while ready:
            fp, side = ready.pop()
            at = (side + 1) % len(pools)
            near = close_to(fp, pools[at])
            if near.any():
                found = pools[at][near]
                pools[at] = pools[at][~near]
                links += [(fp, other) for other in found]
                ready += [(other, at) for other in found]
        seeds = pools[0]
    return links


def linked(fps: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) among the fingerprints that meet under a variant."""
    keys = variant_keys(fps, codes)
    order = np.argsort(keys, kind="stable")
    keys, fps = keys[order], fps[order]
    rest, variant = np.divmod(codes[order].astype(np.uint64), np.uint64(VARIANTS))
    place = variant + rest % np.uint64(2) * np.uint64(BITS)
    bit = np.where(variant < WHOLE, np.uint64(1) << np.minimum(place, np.uint64(63)), np.uint64(0))
    edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    sizes = np.diff(edges)
    a, b = [], []
    small = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    keys_, fps_, bit_ = keys[small], fps[small], bit[small]
    for step in range(1, SMALL):
        apart = fps_[step:] ^ fps_[:-step]
        # under a variant without a bit, only those that differ there
        near = (keys_[step:] == keys_[:-step]) & (np.bitwise_count(apart) <= DISTANCE)
        near &= (apart & bit_[step:]) == bit_[step:]
        a.append(fps_[:-step][near])
        b.append(fps_[step:][near])
    for group in np.flatnonzero(sizes > SMALL):
        at = slice(edges[group], edges[group + 1])
        members = fps[at]
        side = (members & bit[at]) > 0
        # keys may meet by chance, so codes may differ here: distances decide all the same
        pair = (members, None) if variant[at.start] == WHOLE else (members[side], members[~side])
        links = np.array(spanning_links(*pair), np.uint64).reshape(-1, 2)
        a.append(links[:, 0])
        b.append(links[:, 1])
    return np.concatenate(a), np.concatenate(b)


def crowded(classes: DataFrame, total: int, members: int) -> tuple[np.ndarray, np.ndarray]:
    """The segments of either side that more fingerprints share than a task should hold."""
    limit = max(members, 2 * total // HOT_SEGMENTS)
    out = []
    for shift in (0, BITS):
        segment = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << BITS) - 1))
        counted = classes.groupBy(segment.alias("segment")).count().where(F.col("count") > limit)
        found = counted.select("segment").toArrow().column("segment").to_numpy().astype(np.uint64)
        out.append(np.sort(found))
    return tuple(out)


def packed(
    every: np.ndarray, hot: tuple[np.ndarray, np.ndarray], tasks: int
) -> Iterator[pa.RecordBatch]:
    """The variants of all fingerprints by task, DEALT fingerprints at a time."""
    for begin in range(0, len(every), DEALT):
        fps = every[begin : begin + DEALT]
        places, codes = codes_of(fps, hot)
        fps = fps[places]
        task = (variant_keys(fps, codes) % np.uint64(tasks)).astype(np.int32)
        order = np.argsort(task, kind="stable")
        task, codes, fps = task[order], codes[order], fps[order]
        edges = np.flatnonzero(np.concatenate(([True], task[1:] != task[:-1], [True])))
        cuts = list(zip(edges, edges[1:]))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(task[edges[:-1]]),
                pa.array([codes[low:high].tobytes() for low, high in cuts], pa.binary()),
                pa.array([fps[low:high].tobytes() for low, high in cuts], pa.binary()),
            ],
            names=["task", "codes", "fps"],
        )


def links(classes: DataFrame, members: int = HOT_MEMBERS) -> DataFrame:
    """Distinct links (a, b), a < b, that join the fingerprints of ``classes`` (fp)."""
    spark = classes.sparkSession
    total = classes.count()
    hot = spark.sparkContext.broadcast(crowded(classes, total, members))
    tasks = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        -(-total * 2 * VARIANTS // TASK_VARIANTS),
    )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(__name__)
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(batch.column(0).to_numpy().view(np.uint64))
            if sum(map(len, held)) >= DEALT:
                yield from packed(np.concatenate(held), hot.value, tasks)
                held = []
        if held:
            yield from packed(np.concatenate(held), hot.value, tasks)
        held = []
        give_back()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(__name__)
        codes, fps = [], []
        for batch in batches:
            codes += [np.frombuffer(c, np.uint16) for c in batch.column(0).to_pylist()]
            fps += [np.frombuffer(f, np.uint64) for f in batch.column(1).to_pylist()]
        if fps:
            a, b = linked(np.concatenate(fps), np.concatenate(codes))
            codes, fps = [], []
            yield pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]
            )
            del a, b
        give_back()

    dealt = classes.select("fp").mapInArrow(deal, "task int, codes binary, fps binary")
    met = dealt.repartitionById(tasks, F.col("task")).select("codes", "fps")
    return (
        met.mapInArrow(meet, "a long, b long")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    members: int = HOT_MEMBERS,
) -> DataFrame:
    """id, fingerprint (16 lowercase hex digits) and component_id of every row.

    Rows link when their fingerprints differ in at most three bits; component_id is the smallest
    id that links reach, the own one included. Null, empty and wordless texts have the fingerprint
    zero and link like any other; repeated rows are repeated documents. Rows without an id take
    part, but name no component: that of rows without any id is null. An empty table gives no
    rows. Only id and text are read.
    """
    described = shared_table(fingerprints(docs, id_column, text_column), "fingerprints")
    classes = shared_table(
        described.groupBy("fp").agg(F.min(id_column).alias("doc"), F.count("*").alias("n")), "classes"
    )
    found = shared_table(links(classes, members), "links")
    named = classes.select("fp", "n", F.col("doc").alias("component_id"))
    if not found.isEmpty():
        labels = components(found).withColumnRenamed("key", "fp")
        joined = labels.join(classes.select("fp", "doc"), "fp")
        least = joined.groupBy("component").agg(F.min("doc").alias("least"))
        reached = labels.join(least, "component").select("fp", "least", F.lit(True).alias("linked"))
        named = named.join(reached, "fp", "left").select(
            "fp", "n", F.when(F.col("linked"), F.col("least")).otherwise(F.col("component_id"))
            .alias("component_id"),
        )
    named = shared_table(named, "components")

    total = described.count()
    often = F.col("n") > max(HOT_DOCUMENTS, total // HOT_CLASSES)
    crowd = F.broadcast(named.where(often).select("fp", F.col("component_id"), F.lit(True).alias("crowd")))
    marked = described.join(crowd, "fp", "left")
    result = [id_column, "fp", "component_id"]
    rest = marked.where("crowd is null").drop("component_id", "crowd")
    rows = marked.where("crowd").select(*result).unionByName(
        rest.join(named.where(~often), "fp").select(*result)
    )
    return rows.select(
        id_column, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
