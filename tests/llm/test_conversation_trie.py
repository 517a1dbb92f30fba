"""The prefix trie against a plain walk over all conversations."""

import hashlib
import random
import zlib

import pytest

from declarium.llm import conversation_trie
from declarium.llm.common import table

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = (
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
    "ends_sha256",
)


def brute(rows, rebuild=True):
    own: dict = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    for turns in own.values():
        turns.sort()
    plain = {c: [(role, text) for *_, role, text in turns] for c, turns in own.items()}
    built = plain
    if rebuild:
        built = {}
        for c, turns in plain.items():
            h = zlib.crc32(str(c).encode()) % 9
            built[c] = plain.get(c - c % 5, [])[:h] + turns[h:]
    members: dict = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children: dict = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        size = len(node[-1][1].encode()) if node else 0
        leaves[node] = sum(leaves[x] for x in below) or 1
        saved[node] = sum(saved[x] for x in below) + (len(members[node]) - 1) * size
    return sorted(
        (
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs),
            len(children.get(node, [])), leaves[node], saved[node],
            hashlib.sha256(
                ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(node)).encode()
            ).hexdigest(),
        )
        for node, convs in members.items()
    )


def compare(df, rows, rebuild=True, shards=None):
    how = conversation_trie.rebuilt_path if rebuild else None
    found = conversation_trie.prefix_trie(df, how, shards)
    assert sorted(map(tuple, found.select(*COLUMNS).collect()), key=repr) == sorted(
        brute(rows, rebuild), key=repr
    )


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_whole_table(spark, folder):
    df = table(spark, folder, "conversations")
    compare(df, [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize("shards", [1, 2, 7, 60])
def test_copies_over_many_shards(spark, shards, monkeypatch):
    """A third of all conversations are one; others share its first turns, or have none."""
    monkeypatch.setattr(conversation_trie, "SPLITTER_TURNS", 3)
    monkeypatch.setattr(conversation_trie, "CHUNK", 64)
    chance = random.Random(shards)
    rows = []
    for conv in range(600):
        if conv % 3 == 0:
            texts = ["hello", "yes", "go on", "end", "really"]
        else:
            texts = ["hello", *(chance.choice("abc") * chance.randint(0, 3) for _ in range(chance.randint(0, 6)))]
        rows += [(conv * 7, i, "user" if i % 2 else "bot", text) for i, text in enumerate(texts)]
    rows += [(5000, i, "user", f"long {i}") for i in range(300)]
    chance.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    compare(df, rows, shards=shards)
    compare(df, rows, rebuild=False, shards=shards)


def test_odd_rows(spark):
    """Missing values, missing turn numbers, ids below zero or without their family's first one,
    repeated rows, texts of many bytes, and other columns."""
    rows = [
        (None, 0, "user", "nobody's"), (5, None, None, None), (5, 1, "user", "é" * 70_000),
        (5, 1, "user", "é" * 70_000), (6, 0, "user", None), (6, None, "user", "x"), (8, -3, "", "y"),
        (12, 0, "user", "a"), (13, 1, "user", "a"), (14, 2, "user", "a"), (2**60, 0, "user", "a"),
        (10, 3, "user", "b"), (10, 3, "assistant", "b"), (11, 0, "u", "ser"), (9, 0, "us", "er"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("node", "depth", "shard", "path", "family", "cell", "kind", "seq"):
        df = df.withColumn(name, df["text"])
    compare(df, rows)
    compare(df, rows, rebuild=False)


def test_empty_table(spark):
    assert conversation_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
