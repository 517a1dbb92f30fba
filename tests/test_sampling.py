"""Samples against plain Python, on tables whose days and groups are uneven."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from declarium.operators import sampling

SCHEMA = "id string, at timestamp_ntz, n long"


def by_hand(rows, n):
    dated = sorted((r for r in rows if r[1] is not None), key=lambda r: r[0])
    dated.sort(key=lambda r: r[1], reverse=True)
    ordered = dated + sorted((r for r in rows if r[1] is None), key=lambda r: r[0])
    if len(ordered) <= n:
        return {r[0] for r in ordered}
    return {ordered[i * len(ordered) // n][0] for i in range(n)}


def uneven(chance, count, times):
    """A third of the rows on one day; some without a date."""
    rows = []
    for i in range(count):
        day = datetime(2020, 1, 1) + timedelta(days=0 if i % 3 == 0 else chance.randint(0, 900))
        if times:
            day += timedelta(microseconds=chance.randint(0, 86_399_999_999))
        rows.append((f"{chance.getrandbits(64):016x}", day if i % 29 else None, i))
    return rows


@pytest.mark.parametrize("times", [False, True])
@pytest.mark.parametrize("sorted_rows", [0, 1_000_000])
@pytest.mark.parametrize("n", [1, 7, 300, 5000])
def test_systematic(spark, times, sorted_rows, n):
    rows = uneven(random.Random(n), 4000, times)
    df = spark.createDataFrame(rows, SCHEMA)
    found = sampling.systematic(df, "id", "at", n, sorted_rows)
    assert {r.id for r in found.collect()} == by_hand(rows, n)
    as_number = df.withColumn("id", F.col("n"))
    found = sampling.systematic(as_number, "id", "at", n, sorted_rows)
    assert {r.n for r in found.collect()} == by_hand([(r[2], r[1], r[2]) for r in rows], n)


def test_only_days_or_slices_with_a_position_are_sorted(spark, monkeypatch):
    rows = uneven(random.Random(1), 9000, False)
    df = spark.createDataFrame(rows, SCHEMA)
    seen = []
    sort = sampling.dense_positions
    monkeypatch.setattr(
        sampling, "dense_positions", lambda df, *rest: seen.append(df.count()) or sort(df, *rest)
    )
    sampling.systematic(df, "id", "at", 20)
    sampling.systematic(df, "id", "at", 20, sorted_rows=0)
    # the days hold a third of all rows and a little more; their slices a tenth of all
    assert seen[0] < 3500 and seen[1] < 1000


def test_keys_in_order(spark):
    chance = random.Random(2)
    keys = ["", "a", "bé", "\U0001f600", "zzzzzzzzzz"]
    keys += ["".join(chance.choice("abéz") for _ in range(chance.randint(1, 9))) for _ in range(200)]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    rows = df.select("k", sampling.key_number(df, "k").alias("v")).orderBy("k").collect()
    assert [r.v for r in rows] == sorted(r.v for r in rows)


@pytest.mark.parametrize("k", [1, 12, 5000])
def test_first_of_a_hot_group(spark, k):
    """A third of 60,000 rows in one group, and k beyond what Spark cuts before the shuffle."""
    df = spark.range(60_000, numPartitions=40).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"),
        (F.col("id") * 7919 % 60_013).alias("v"),
    )
    old = spark.conf.get(sampling.GROUP_LIMIT)
    spark.conf.set(sampling.GROUP_LIMIT, "1000")
    try:
        found = sampling.head_per_group(df, "g", [F.col("v")], k, spread=4)
        text = found._jdf.queryExecution().executedPlan().toString()
        rows = found.collect()
    finally:
        spark.conf.set(sampling.GROUP_LIMIT, old)
    groups = {}
    for r in df.collect():
        groups.setdefault(r.g, []).append(r.v)
    expected = {(g, v) for g, values in groups.items() for v in sorted(values)[:k]}
    assert {(r.g, r.v) for r in rows} == expected and len(rows) == len(expected)
    # each window cuts to k before and after its shuffle
    assert text.count("WindowGroupLimit") == (4 if k > 1000 else 2)


def test_no_task_holds_a_hot_group(spark):
    """The rows that meet under (group, part) and those that the last window gets."""
    df = spark.range(90_000, numPartitions=60).select(
        F.lit("hot").alias("g"), (F.col("id") * 7919 % 90_001).alias("v")
    )
    part = F.pmod(F.spark_partition_id(), F.lit(4))
    cut = sampling.first_of(df.withColumn("_part", part), ["g", "_part"], [F.col("v")], 1000)
    assert cut.count() == 4000
