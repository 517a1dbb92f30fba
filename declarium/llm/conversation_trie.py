"""Prefix trie of conversations: sorted shards between splitter paths, joined by their skeleton.

A conversation is a path of cells, one a turn: a digest of role and text and the text's size. Paths
compare as bytes, so sorting them visits the trie depth first.

1. Turns become cells in the scan; only cells are shuffled, to one sorted run a conversation.
2. Splitters, taken from a sample of (path, conversation), cut the sorted paths into shards. Copies
   of one path are cut between conversations, so no shard gathers a conversation that many repeat.
3. The trie of the splitters' paths, the skeleton, is broadcast. A node that no splitter passes
   through has its whole subtree in one shard, which finishes it while streaming. Nodes of the
   skeleton get one partial row from every shard that meets them.
4. Partial rows are reduced by node. Counts and sizes below a node add up; its smallest member is a
   minimum; what depends on a sum (the saving of a node, whether it is a leaf) is put together from
   sums and from the skeleton itself.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from declarium.llm.common import shared_table
from declarium.operators.scale import dense_positions

# Bytes of a cell: an MD5 digest of role and text, and the text's bytes (big endian).
DIGEST, CELL = 16, 20
# Path bytes that a shard should hold, and sampled conversations a shard.
SHARD_BYTES = 32 << 20
SAMPLED = 32
# The skeleton's bound: so many splitters at most, each cut to so many turns (20 MB in all). A cut
# splitter stands before all paths that begin with it.
SPLITTERS = 4096
SPLITTER_TURNS = 256
# Bytes of ids that a shard passes on at once for a node of the skeleton; rows of a batch.
CHUNK = 1 << 20
ROWS = 10_000
# Conversations of a family, and turns taken over from its first one, at most (see rebuilt_path).
FAMILY, TAKEN = 5, 9

EMPTY = hashlib.sha256(b"").hexdigest()
NODE, PART, ENDS = 0, 1, 2

Rebuild = Callable[[int, bytes, bytes], bytes]


def rebuilt_path(conv: int, own: bytes, first: bytes) -> bytes:
    """The first h turns of the family's first conversation, then the own turns after h.

    h is the CRC-32 of the id modulo TAKEN; ``first`` is empty where there is no such conversation.
    """
    taken = zlib.crc32(str(conv).encode()) % TAKEN * CELL
    return first[:taken] + own[taken:]


def cells(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, cell) of every turn that has a conversation; JVM expressions only."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    size = F.lpad(F.hex(F.octet_length(text)), 2 * (CELL - DIGEST), "0")
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn"),
        role.alias("role"),
        F.unhex(F.concat(digest, size)).alias("cell"),
    )


def paths(conversations: DataFrame, rebuild: Rebuild | None = None) -> DataFrame:
    """(conv_id, path): the cells of every conversation in the order of its turns.

    Turns go by number, missing numbers first; equal numbers by role, then by the digest of role
    and text. With ``rebuild``, the family ``conv_id - conv_id % FAMILY`` is read together, its
    first conversation before the others, whose first turns ``rebuild`` may take over.
    """
    family = F.col("conv_id") - (F.col("conv_id") % FAMILY if rebuild else F.lit(0))
    turns = cells(conversations).withColumn("family", family)
    runs = turns.repartition("family").sortWithinPartitions(
        "family", F.col("conv_id") != F.col("family"), "conv_id",
        F.col("turn").asc_nulls_first(), "role", "cell",
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found, held = [], [], 0
        now, family, first, own = None, None, b"", bytearray()

        def close() -> None:
            nonlocal first, held
            path = bytes(own)
            if rebuild:
                if now == family:
                    first = path[: TAKEN * CELL]
                else:
                    path = rebuild(now, path, first)
            ids.append(now)
            found.append(path)
            held += len(path)

        def batch_of() -> pa.RecordBatch:
            nonlocal held
            out = pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(found, pa.binary())], names=["conv_id", "path"]
            )
            ids.clear(), found.clear()
            held = 0
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            convs, families = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data = b"".join(batch.column(2).to_pylist())
            edges = [0, *(np.flatnonzero(np.diff(convs)) + 1).tolist(), len(convs)]
            for low, high in zip(edges, edges[1:]):
                conv = int(convs[low])
                if conv != now:
                    if now is not None:
                        close()
                    if int(families[low]) != family:
                        family, first = int(families[low]), b""
                    now, own = conv, bytearray()
                own += data[low * CELL : high * CELL]
                if len(ids) >= ROWS or held >= 8 * CHUNK:
                    yield batch_of()
        if now is not None:
            close()
            yield batch_of()

    return runs.select("conv_id", "family", "cell").mapInArrow(join, "conv_id long, path binary")


def splitters(paths: DataFrame, shards: int, count: int) -> list[tuple[bytes, int]]:
    """At most ``shards`` - 1 places (path, conv_id) that cut the sorted paths evenly.

    They come from a sample by hash of the id; any places give the same result.
    """
    share = min(1.0, SAMPLED * shards / max(count, 1))
    width = SPLITTER_TURNS * CELL
    sample = paths.where(
        F.pmod(F.xxhash64("conv_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    ).select(
        F.expr(f"substring(path, 1, {width})").alias("path"),
        # a cut path stands before all conversations that go on from it
        F.when(F.octet_length("path") > width, F.lit(-(1 << 63))).otherwise(F.col("conv_id")).alias("conv"),
    )
    placed = dense_positions(sample, [F.col("path"), F.col("conv")], "place")
    total = placed.count()
    step = max(1, -(-total // shards))
    chosen = placed.where((F.col("place") % step == 0) & (F.col("place") > 0))
    return sorted({(bytes(row.path), row.conv) for row in chosen.select("path", "conv").collect()})


class Skeleton:
    """The trie of the splitters' paths, numbered depth first; 0 is the root."""

    def __init__(self, splitters: list[tuple[bytes, int]]) -> None:
        self.children: list[dict[bytes, int]] = [{}]
        self.parent, self.depth, self.size = [-1], [0], [0]
        for path, _ in splitters:  # sorted, so numbers go depth first
            at = 0
            for low in range(0, len(path), CELL):
                cell = path[low : low + CELL]
                if cell not in self.children[at]:
                    self.children[at][cell] = len(self.parent)
                    self.children.append({})
                    self.parent.append(at)
                    self.depth.append(self.depth[at] + 1)
                    self.size.append(int.from_bytes(cell[DIGEST:], "big"))
                at = self.children[at][cell]

    def table(self) -> pa.Table:
        """node, parent, depth, inner (children within the skeleton), bytes (of all texts below)."""
        below = list(self.size)
        for node in range(len(below) - 1, 0, -1):
            below[self.parent[node]] += below[node]
        return pa.table(
            {
                "node": pa.array(range(len(below)), pa.int64()),
                "parent": pa.array(self.parent, pa.int64()),
                "depth": pa.array(self.depth, pa.int64()),
                "inner": pa.array(map(len, self.children), pa.int64()),
                "bytes": pa.array(below, pa.int64()),
            }
        )

    def above_ends(self) -> pa.Table:
        """(node, above): every node without children here, with itself and all nodes above it."""
        ends, above = [], []
        for node, children in enumerate(self.children):
            at = node if not children else -1
            while at >= 0:
                ends.append(node)
                above.append(at)
                at = self.parent[at]
        return pa.table({"node": pa.array(ends, pa.int64()), "above": pa.array(above, pa.int64())})


def common_turns(a: bytes, b: bytes) -> int:
    """How many leading cells two paths share."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most // CELL
    step = np.frombuffer(a, np.uint8, most) != np.frombuffer(b, np.uint8, most)
    return int(step.argmax()) // CELL


class Open:
    """A node on the path being read, with what its subtree has given so far."""

    __slots__ = (
        "skeleton", "size", "n", "least", "kids", "leaves", "saved", "weight", "ends", "chunk", "held",
        "sent",
    )

    def __init__(self, skeleton: int, size: int) -> None:
        self.skeleton, self.size = skeleton, size
        self.n = self.kids = self.leaves = self.saved = self.weight = self.held = self.sent = 0
        self.least = None
        self.ends, self.chunk = None, []


class Rows:
    """Finished rows of one task, by kind, in the order they end."""

    FIELDS = {
        "kind": pa.int32(), "shard": pa.int32(), "seq": pa.int64(), "node": pa.int64(),
        "depth": pa.int64(), "conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(),
        "n_leaves": pa.int64(), "saved": pa.int64(), "weight": pa.int64(), "ends": pa.string(),
    }

    def __init__(self) -> None:
        self.columns: dict[str, list] = {name: [] for name in self.FIELDS}
        self.seq = self.held = 0

    def add(self, kind, shard, node, depth, least, n, kids, leaves, saved, weight, ends) -> None:
        row = (kind, shard, self.seq, node, depth, least, n, kids, leaves, saved, weight, ends)
        for values, value in zip(self.columns.values(), row):
            values.append(value)
        self.seq += 1
        self.held += 100 + len(ends or "")

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array(v, self.FIELDS[name]) for name, v in self.columns.items()],
            names=list(self.columns),
        )
        for values in self.columns.values():
            values.clear()
        self.held = 0
        return out


class Walk:
    """Reads a shard's paths in order and keeps the nodes on the current one open."""

    def __init__(self, skeleton: Skeleton, rows: Rows) -> None:
        self.skeleton, self.rows = skeleton, rows
        self.shard, self.path, self.stack = None, b"", []

    def read(self, shard: int, path: bytes, conv: int) -> None:
        if shard != self.shard:
            self.close(-1)
            self.shard, self.path, self.stack = shard, b"", [Open(0, 0)]
        if path != self.path or len(self.stack) == 1:
            shared = common_turns(path, self.path)
            self.close(shared)
            for depth in range(len(self.stack) - 1, len(path) // CELL):
                above = self.stack[-1].skeleton
                cell = path[depth * CELL : (depth + 1) * CELL]
                node = self.skeleton.children[above].get(cell, -1) if above >= 0 else -1
                if above >= 0 > node or above < 0:
                    self.stack[-1].kids += 1
                self.stack.append(Open(node, int.from_bytes(cell[DIGEST:], "big")))
            self.path = path
        self.end(self.stack[-1], conv)

    def end(self, node: Open, conv: int) -> None:
        """A conversation that ends at a node; they come in ascending order."""
        node.n += 1
        if node.least is None or conv < node.least:
            node.least = conv
        if node.skeleton >= 0:
            text = str(conv)
            node.chunk.append(text)
            node.held += len(text) + 1
            if node.held >= CHUNK:
                self.pass_ids(node)
        elif node.ends is None:
            node.ends = hashlib.sha256(str(conv).encode())
        else:
            node.ends.update(b",%d" % conv)

    def pass_ids(self, node: Open) -> None:
        if node.chunk:
            self.rows.add(
                ENDS, self.shard, node.skeleton, 0, None, 0, 0, 0, 0, node.sent, ",".join(node.chunk)
            )
            node.sent += 1
            node.chunk, node.held = [], 0

    def close(self, depth: int) -> None:
        """End the open nodes below a depth."""
        while len(self.stack) > depth + 1:
            node = self.stack.pop()
            above = self.stack[-1] if self.stack else None
            if node.skeleton >= 0:
                self.pass_ids(node)
                node.weight += node.n * node.size
                self.rows.add(
                    PART, self.shard, node.skeleton, 0, node.least, node.n, node.kids, node.leaves,
                    node.saved, node.weight, None,
                )
            else:
                node.leaves = node.leaves or 1
                node.saved += (node.n - 1) * node.size
                ends = node.ends.hexdigest() if node.ends else EMPTY
                self.rows.add(
                    NODE, self.shard, above.skeleton, len(self.stack), node.least, node.n, node.kids,
                    node.leaves, node.saved, 0, ends,
                )
            if above is not None:
                above.n += node.n
                above.leaves += node.leaves
                above.saved += node.saved
                above.weight += node.weight
                if above.least is None or node.least < above.least:
                    above.least = node.least


def shard_rows(paths: DataFrame, places: list[tuple[bytes, int]], skeleton: Skeleton) -> DataFrame:
    """The rows of all shards: finished nodes, partial rows of the skeleton, and its members' ids.

    A node's parent ends after it; so a second pass, which reads a shard's rows backwards, knows
    the parent's smallest member before the children come.
    """
    spark = paths.sparkSession
    shared = spark.sparkContext.broadcast((places, skeleton))
    shards = len(places) + 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value[0]
        for batch in batches:
            keys = zip(batch.column(1).to_pylist(), batch.column(0).to_pylist())
            found = pa.array([bisect_right(places, key) for key in keys], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [found, *batch.columns], names=["shard", "conv_id", "path"]
            )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows()
        walk = Walk(shared.value[1], rows)
        for batch in batches:
            for shard, conv, path in zip(*(column.to_pylist() for column in batch.columns)):
                walk.read(shard, path, conv)
                if rows.held >= 4 * CHUNK:
                    yield rows.batch()
        walk.close(-1)
        if rows.seq:
            yield rows.batch()

    def parents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: list[int] = []
        for batch in batches:
            found = []
            names = ("kind", "node", "depth", "conv_id")
            for kind, node, depth, conv in zip(*(batch.column(n).to_pylist() for n in names)):
                if kind != NODE:
                    found.append(None)
                    continue
                found.append(None if node >= 0 else least[depth - 1])
                least[depth:] = [*([0] * (depth - len(least))), conv]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.int64())],
                names=[*batch.schema.names, "parent_conv_id"],
            )

    fields = (
        "kind int, shard int, seq long, node long, depth long, conv_id long, n_convs long, "
        "n_children long, n_leaves long, saved long, weight long, ends string"
    )
    dealt = paths.select("conv_id", "path").mapInArrow(deal, "shard int, conv_id long, path binary")
    # shards are dealt by number, so no two of them meet in a task
    held = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id")
    ended = held.mapInArrow(walk, fields).sortWithinPartitions("shard", F.desc("seq"))
    return ended.mapInArrow(parents, f"{fields}, parent_conv_id long")


def member_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of skeleton nodes, from the ids that the shards passed on.

    A digest needs its ids in order, so a node's chunks are streamed through one task; a task
    holds one chunk at a time.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, nodes, found = None, None, [], []
        for batch in batches:
            for node, text in zip(*(batch.column(n).to_pylist() for n in ("node", "ends"))):
                if node != now:
                    if state is not None:
                        nodes.append(now)
                        found.append(state.hexdigest())
                    now, state = node, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
        if state is not None:
            nodes.append(now)
            found.append(state.hexdigest())
        if nodes:
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(found)], names=["node", "ends_sha256"]
            )

    # weight holds a chunk's number within its shard
    held = ends.repartition("node").sortWithinPartitions("node", "shard", "weight")
    return held.select("node", "ends").mapInArrow(digest, "node long, ends_sha256 string")


def skeleton_nodes(rows: DataFrame, skeleton: Skeleton) -> DataFrame:
    """The skeleton's nodes, reduced from the shards' partial rows.

    It has at most SPLITTERS * SPLITTER_TURNS nodes, and so are the tables joined here.
    """
    spark = rows.sparkSession
    reduced = shared_table(
        rows.where(F.col("kind") == PART)
        .groupBy("node")
        .agg(
            F.min("conv_id").alias("conv_id"),
            *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved", "weight")),
        ),
        "skeleton",
    )
    fixed = spark.createDataFrame(skeleton.table())
    bare = reduced.where("n_children = 0").select("node")
    # a node without children here is a leaf of all above it, unless some shard found children
    leaves = (
        spark.createDataFrame(skeleton.above_ends())
        .join(bare, "node", "left_semi")
        .groupBy(F.col("above").alias("node"))
        .agg(F.count("*").alias("bare"))
    )
    digests = member_digests(rows.where(F.col("kind") == ENDS))
    parents = reduced.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (
        reduced.join(fixed, "node")
        .join(leaves, "node", "left")
        .join(digests, "node", "left")
        .join(parents, "parent", "left")
        .select(
            "node", "conv_id", "depth", "parent_conv_id", "n_convs",
            (F.col("n_children") + F.col("inner")).alias("n_children"),
            (F.col("n_leaves") + F.coalesce("bare", F.lit(0))).alias("n_leaves"),
            (F.col("saved") + F.col("weight") - F.col("bytes")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
        )
    )


def prefix_trie(
    conversations: DataFrame, rebuild: Rebuild | None = None, shards: int | None = None
) -> DataFrame:
    """A row for each distinct sequence of leading turns (role, text), the empty one included.

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children,
    n_leaves, saved_tokens (text bytes that sharing saves in the subtree) and ends_sha256 (of the
    ids that end at the node, in ascending order, joined by commas).

    Reads conv_id, turn, role and text; other columns are ignored. Missing role or text counts as
    empty. Turns without conv_id belong to no conversation. Missing turn numbers come first, equal
    ones are ordered by role and digest, and repeated rows are repeated turns. An empty table has
    no nodes, not even the root. Turns are told apart by an MD5 digest and the text's size.
    A conversation's cells (20 bytes a turn) pass through a task as one value.
    """
    spark = conversations.sparkSession
    made = shared_table(paths(conversations, rebuild), "paths")
    count, size = made.agg(F.count("*"), F.sum(F.octet_length("path").cast("long"))).first()
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // SHARD_BYTES))
    places = splitters(made, min(shards or wanted, SPLITTERS), count)
    skeleton = Skeleton(places)
    rows = shared_table(shard_rows(made, places, skeleton), "trie")
    top = shared_table(skeleton_nodes(rows, skeleton), "top")
    above = top.select("node", F.col("conv_id").alias("above"))
    names = [
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        "ends_sha256",
    ]
    nodes = (
        rows.where(F.col("kind") == NODE)
        .join(F.broadcast(above), "node", "left")
        .withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
        .withColumnsRenamed({"saved": "saved_tokens", "ends": "ends_sha256"})
    )
    return nodes.select(*names).unionByName(top.select(*names))
