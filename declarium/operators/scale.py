"""What several operators need to stay safe on large and skewed data."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Above this many rows, or bytes, a lookup table is joined by shuffle, not sent to every executor.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only in local mode."""
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("Set spark.checkpoint.dir to a folder all executors share.")
            folder = tempfile.mkdtemp(prefix="declarium-")
        context.setCheckpointDir(folder)
    return folder


def fixed(df: DataFrame) -> DataFrame:
    """Written once to the shared checkpoint folder, so every later use sees the same rows.

    For small results that several branches of a plan read: the scan behind them runs once
    and a lost executor costs nothing.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def row_bytes(df: DataFrame) -> Column:
    """About what a row takes: texts and arrays as long as they are, everything else a word."""
    size = F.lit(0).cast("long")
    for field in df.schema.fields:
        name = F.col(f"`{field.name}`")
        plain = field.dataType.typeName() not in ("string", "binary", "array", "map", "struct", "variant")
        text = F.octet_length(name if field.dataType.typeName() == "binary" else name.cast("string"))
        size = size + F.lit(8) + (F.lit(0) if plain else F.coalesce(text, F.lit(0)))
    return size


def is_small(rows: int, size: int | None, limit: int | None = None) -> bool:
    return rows <= (BROADCAST_ROWS if limit is None else limit) and (size or 0) <= BROADCAST_BYTES


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint if the table is found to be small; as it is otherwise.

    Without the hint the join is a shuffle join that adaptive execution splits on hot keys.
    Counting stops after ``limit + 1`` rows; what they take together counts as well.
    """
    rows, size = df.limit(limit + 1).agg(F.count(F.lit(1)), F.sum(row_bytes(df))).first()
    return F.broadcast(df) if is_small(rows, size, limit) else df


def dense_positions(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number the rows 0, 1, 2, … in the given order, without a one-task window.

    A global sort splits the rows into ranges; each row gets its place within its range,
    and the ranges' sizes (one row per shuffle partition) give every range its offset.
    The sorted rows are fixed first: sizes and places must come from the same split.
    """
    placed = fixed(
        df.orderBy(*order)
        .withColumn("_place", F.monotonically_increasing_id())
        .withColumn("_range", F.shiftrightunsigned("_place", 33).cast("int"))
        .withColumn("_place", F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)))
    )
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    return (
        placed.join(F.broadcast(offsets), "_range")
        .withColumn(name, F.col("_place") + F.col("_offset"))
        .drop("_range", "_place", "_offset")
    )
