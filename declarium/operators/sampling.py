"""Review samples."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from declarium.operators.filters import require_range
from declarium.operators.scale import BROADCAST_ROWS, dense_positions

# Up to this many first rows of a group Spark cuts in every task before the shuffle, by default.
GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"
# Tasks that cut a group's rows side by side before the last one merges them.
SPREAD = 32

# More rows than this are not sorted at once: the days they lie on are cut into slices first.
SORTED_ROWS = 1_000_000
SLICES = 256
# Leading bytes of a text key that tell its slice.
KEY_BYTES = 6


def head(df: DataFrame, order: list[Column], n: int = 1000) -> DataFrame:
    """The first n rows; a distributed top-k, not a sort of the table."""
    return df.orderBy(*order).limit(n)


def head_per_group(
    df: DataFrame, group: str, order: list[Column], k: int = 12, spread: int = SPREAD
) -> DataFrame:
    """The first k rows of every group, for any k.

    Each task cuts to k before the shuffle, also beyond the size up to which Spark does so of its
    own accord: that setting is raised for the session, never lowered. A large k makes that many
    rows a task and group, so up to ``spread`` tasks then cut a group's rows side by side, and the
    last one merges at most ``spread * k`` of them.
    """
    require_range("k", k, 1)
    spark = df.sparkSession
    usual = int(spark.conf.get(GROUP_LIMIT))
    if k > usual:
        spark.conf.set(GROUP_LIMIT, str(k))
        part = F.pmod(F.spark_partition_id(), F.lit(spread))
        df = first_of(df.withColumn("_part", part), [group, "_part"], order, k).drop("_part")
    return first_of(df, [group], order, k)


def first_of(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") <= k).drop("_rank")


def systematic(
    df: DataFrame, key: str, date: str, n: int = 1000, sorted_rows: int = SORTED_ROWS
) -> DataFrame:
    """n rows at even steps through the table, newest first: positions ``int(i * rows / n)``.

    ``key`` must identify a row. Counts by day tell which days hold the wanted positions; where
    those days still have many rows, each is cut into slices, by time or, if all its rows have one
    time, by key, and counted again. Only date and key of the days or slices that hold a position
    are sorted. The at most n keys found there then pick their rows in a last scan.
    """
    require_range("n", n, 1)
    narrow = df.select(key, date, F.col(date).cast("date").alias("_day"))
    moment, place = time_of_day(date), key_number(df, key)
    days = (
        narrow.groupBy("_day")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min(moment).alias("first"), F.max(moment).alias("last"),
            F.min(place).alias("low"), F.max(place).alias("high"),
        )
        .collect()
    )
    rows = sum(day.rows for day in days)
    if rows <= n:
        return df
    # newest first, the missing day last
    days.sort(key=lambda day: (day._day is not None, day._day), reverse=True)
    wanted = [i * rows // n for i in range(n)]
    buckets = [((day._day,), day.rows) for day in days]
    kept, targets = held(buckets, wanted)
    chosen = {bucket[0] for bucket, _ in kept}
    schema = [T.StructField("_on", T.DateType())]
    narrow = narrow.withColumn("_slice", F.lit(0))
    if sum(size for _, size in kept) > sorted_rows:
        bounds = [day for day in days if day._day in chosen]
        narrow = with_slices(narrow, bounds, moment, place)
        sizes = narrow.groupBy("_day", "_slice").count().collect()
        sizes = {(row._day, row._slice): row["count"] for row in sizes}
        on = {day: [] for day in chosen}
        for (day, number), size in sorted(sizes.items(), key=lambda item: item[0][1]):
            on[day].append(((day, number), size))
        buckets = [bucket for day in bounds for bucket in on[day._day]]
        kept, targets = held(buckets, targets)
        schema.append(T.StructField("_at", T.IntegerType()))
    places = narrow.sparkSession.createDataFrame([b for b, _ in kept], T.StructType(schema))
    same = F.col("_day").eqNullSafe(F.col("_on"))
    if len(schema) > 1:
        same = same & (F.col("_slice") == F.col("_at"))
    # n buckets at most
    near = narrow.join(F.broadcast(places), same, "left_semi").select(key, date)
    placed = dense_positions(near, [F.col(date).desc_nulls_last(), F.col(key)], "_position")
    numbers = places.sparkSession.createDataFrame([(t,) for t in targets], "_position bigint")
    keys = placed.join(F.broadcast(numbers), "_position", "left_semi").select(key)
    return df.join(F.broadcast(keys) if n <= BROADCAST_ROWS else keys, key, "left_semi")


def held(buckets: list[tuple[tuple, int]], wanted: list[int]) -> tuple[list, list[int]]:
    """The buckets (name, rows), in order, that hold a wanted position, and the positions in them."""
    starts = [0, *accumulate(size for _, size in buckets)]
    kept, targets, before, last = [], [], 0, None
    for position in wanted:
        at = bisect_right(starts, position) - 1
        if at != last:
            before += kept[-1][1] if kept else 0
            kept.append(buckets[at])
            last = at
        targets.append(before + position - starts[at])
    return kept, targets


def time_of_day(date: str) -> Column:
    """Seconds since midnight, with their fraction."""
    second = F.expr(f"extract(SECOND FROM CAST(`{date}` AS TIMESTAMP_NTZ))").cast("double")
    return F.hour(date) * 3600 + F.minute(date) * 60 + second


def key_number(df: DataFrame, key: str) -> Column:
    """A number that never falls where the key rises."""
    if isinstance(df.schema[key].dataType, T.NumericType):
        return F.col(key).cast("double")
    first = F.rpad(F.hex(F.substring(F.col(key).cast("string").cast("binary"), 1, KEY_BYTES)), 2 * KEY_BYTES, "0")
    return F.conv(first, 16, 10).cast("double")


def with_slices(rows: DataFrame, days: list, moment: Column, place: Column) -> DataFrame:
    """The rows of the given days, numbered by slice in the order of the sample."""
    bounds = rows.sparkSession.createDataFrame(
        [(d._day, d.first, d.last, d.low, d.high) for d in days],
        "_on date, _first double, _last double, _low double, _high double",
    )
    cut = rows.join(F.broadcast(bounds), F.col("_day").eqNullSafe(F.col("_on")))
    by_time = (F.col("_last") - moment) / (F.col("_last") - F.col("_first"))
    by_key = (place - F.col("_low")) / (F.col("_high") - F.col("_low"))
    share = F.when(F.col("_last") > F.col("_first"), by_time).when(F.col("_high") > F.col("_low"), by_key)
    number = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * SLICES), F.lit(SLICES - 1)).cast("int")
    return cut.withColumn("_slice", number).drop(*bounds.columns)
