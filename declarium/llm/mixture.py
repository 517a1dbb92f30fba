"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

A source's documents are dealt to shards of bounded size and laid end to end in a seeded order;
each shard is cut into blocks of (nearly) equal words. Blocks go to the sources by highest
quotients weight / (2 seats + 1), a source's blocks to its shards alike, and each shard takes
its quota of blocks in a seeded order, going through all of them before any is repeated.

Sources and shards stay in Spark, however many there are. What the seats depend on is the level of
the last quotient. A bounded number of sources, or of shards of a source, is dealt in one task; for
more, aggregations count the seats above many levels at once and close in on it, for all groups
together. The driver sees no more than a few sums.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from declarium.llm.common import shared_table
from declarium.operators.scale import broadcast_if_small, dense_positions

WORD = r"[^\x20\x09-\x0D]+"
# Weights of the sources in order of name, repeating.
WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
BLOCK_WORDS = 16
# Documents of a shard, on average: the largest group that one task sorts.
SHARD_DOCS = 4_096
# Sources, or shards of a source, that one task apportions.
AT_ONCE = 100_000
# Beyond that: levels that one aggregation tries, and aggregations: what is left between two levels after them
# differs in less than one part in 10^10.
LEVELS, PASSES = 32, 9
SEED = 20_240


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_quotas(
    totals: DataFrame, weights: tuple[int, ...], most: int, block_words: int
) -> DataFrame:
    """Every source (_source, words, docs) with its _number, weight, target and _quota of blocks."""
    order = [F.col("_source").isNull(), F.col("_source")]
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    numbered = shared_table(
        dense_positions(totals, order, "_number")
        .withColumn("weight", F.get(cycle, (F.col("_number") % len(weights)).cast("int")))
        .withColumn("limit", F.col("words") * float(most)),
        "sources",
    )
    level = target_level(numbered)
    blocks = F.ceil(F.col("words") / block_words)
    aimed = numbered.withColumn("target", F.least(F.col("weight") * level, F.col("limit"))).select(
        "_number", "_source", "docs", F.col("words").alias("source_size"), "target",
        # blocks of the source's own size that make up its target
        F.when(F.col("words") > 0, F.col("target") / (F.col("words") / blocks)).otherwise(0.0)
        .alias("weight"),
        (blocks * most).alias("most"),
    )
    seats = aimed.agg(F.round(F.sum("weight"))).first()[0] or 0.0
    dealt = apportion(aimed.withColumn("seats", F.lit(int(seats))).withColumn("all", F.lit(0)), "all", "_number")
    return dealt.withColumnRenamed("given", "_quota").drop("all", "weight", "most", "seats")


def target_level(sources: DataFrame) -> float:
    """Words for each unit of weight: what sources at their limit leave over is shared by the others.

    Starts with none at its limit. Each round's level is that of the others; it only rises, and
    with it the sources at their limit, until none is added.
    """
    total, weight = sources.agg(F.sum("words"), F.sum("weight")).first()
    if not total:
        return 0.0
    level, reached = total / weight, -1
    while True:
        full = F.col("weight") * level > F.col("limit")
        count, taken, left = sources.agg(
            F.count_if(full), F.sum(F.when(full, F.col("limit"))), F.sum(F.when(~full, F.col("weight")))
        ).first()
        if count == reached or not left:
            return level
        level, reached = (total - (taken or 0.0)) / left, count


def seats_of(weights: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by highest quotients weight / (2 k + 1), none above its limit; ties to the first."""
    given = np.zeros(len(weights), np.int64)
    some = weights > 0
    seats = min(seats, int(most[some].sum()))
    if seats <= 0:
        return given

    def above(level: float) -> np.ndarray:  # seats with a quotient of at least the level
        return np.where(some, np.minimum(np.floor((weights / level + 1) / 2), most), 0).astype(np.int64)

    low, high = weights[some].min() / (2.0 * seats + 3) / 4, weights.max() * 2
    for _ in range(200):
        level = (low * high) ** 0.5
        if above(level).sum() > seats:
            low = level
        else:
            high = level
    given = above(high)
    while given.sum() < seats:
        quotients = np.where(some & (given < most), weights / (2 * given + 1), -1.0)
        given[int(quotients.argmax())] += 1
    return given


def apportion(rows: DataFrame, group: str, number: str, at_once: int = AT_ONCE) -> DataFrame:
    """``given`` seats for every row by highest quotients weight / (2 k + 1), none above ``most``.

    ``seats`` is the number for the whole group; ties go to the smallest ``number``. Groups of up to
    ``at_once`` rows are dealt in a task each. If some are larger, the same is done by aggregations,
    for all groups together: every pass counts the seats above LEVELS levels between two bounds and
    keeps the two around the wanted number. What is above the upper one is given at once, what is
    left over one by one.
    """
    rows = shared_table(rows, "seats")
    largest = rows.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    if largest <= at_once:

        def deal(own: pd.DataFrame) -> pd.DataFrame:
            own = own.sort_values(number, ignore_index=True)
            weights, most = own["weight"].to_numpy(float), own["most"].to_numpy(np.int64)
            own["given"] = seats_of(weights, int(own["seats"].max()), most) if len(own) else []
            return own[[group, number, "given"]]

        kinds = dict(rows.dtypes)
        narrow = rows.select(group, number, "weight", "most", "seats")
        dealt = narrow.groupBy(group).applyInPandas(
            deal, f"{group} {kinds[group]}, {number} {kinds[number]}, given long"
        )
        return rows.join(dealt, [group, number])

    def above(level: Column) -> Column:
        return F.least(F.floor((F.col("weight") / level + 1) / 2), F.col("most")).cast("long")

    some = F.col("weight") > 0
    bounds = rows.groupBy(group).agg(
        F.least(F.max("seats"), F.sum(F.when(some, F.col("most")))).alias("_wanted"),
        F.min(F.when(some, F.col("weight"))).alias("_low"),
        (F.max("weight") * 2).alias("_high"),
    )
    bounds = shared_table(
        bounds.where("_wanted > 0").withColumn("_low", F.col("_low") / (2.0 * F.col("_wanted") + 3) / 4),
        "levels",
    )
    for _ in range(PASSES):
        step = F.pow(F.col("_high") / F.col("_low"), F.lit(1.0 / LEVELS))
        levels = [F.col("_low"), *[F.col("_low") * F.pow(step, F.lit(float(j))) for j in range(1, LEVELS)]]
        levels.append(F.col("_high"))
        counted = (
            rows.where(some)
            .join(bounds.withColumn("_levels", F.array(*levels)), group)
            .groupBy(group)
            .agg(
                F.first("_wanted").alias("_wanted"), F.first("_levels").alias("_levels"),
                F.array(*[F.sum(above(F.get("_levels", F.lit(j)))) for j in range(LEVELS + 1)]).alias("_seats"),
            )
        )
        # the first level with no more seats than wanted, and the one before it
        at = F.array_position(F.transform("_seats", lambda n: n <= F.col("_wanted")), True).cast("int")
        bounds = shared_table(
            counted.select(
                group, "_wanted", F.get("_levels", F.greatest(at - 2, F.lit(0))).alias("_low"),
                F.get("_levels", at - 1).alias("_high"),
            ),
            "levels",
        )
    placed = rows.join(bounds.select(group, "_wanted", "_high"), group, "left")
    sure = F.when(some & F.col("_high").isNotNull(), above(F.col("_high"))).otherwise(0)
    given = shared_table(placed.withColumn("given", sure.cast("long")), "given")
    rest = given.groupBy(group).agg((F.max("_wanted") - F.sum("given")).alias("_rest")).where("_rest > 0")
    # no more rows than are left over, each with its next quotient
    quotient = F.col("weight") / (2 * F.col("given") + 1)
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("_next"), number))
    last = (
        given.where(some & (F.col("given") < F.col("most")))
        .join(rest, group)
        .select(group, number, quotient.alias("_next"), "_rest")
        .withColumn("_place", place)
        .where(F.col("_place") <= F.col("_rest"))
        .select(group, number, F.lit(1).alias("_one"))
    )
    return (
        given.join(last, [group, number], "left")
        .withColumn("given", F.col("given") + F.coalesce("_one", F.lit(0)))
        .drop("_one", "_wanted", "_high")
    )


def mixture(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_REPEATS,
    block_words: int = BLOCK_WORDS,
    seed: int = SEED,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    shard_docs: int = SHARD_DOCS,
    whole_rows: bool = False,
) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row, and on request ``row``, all of it.

    Sizes are counts of words; null and empty texts have none and take none. Sources are in the
    order of their code points, null last, a source of its own. A source without words has a
    target of 0. Equal rows are separate documents. The order within a shard depends on seed,
    id and text only, so reruns agree; rows equal in both have equal places in any order.
    """
    spark = docs.sparkSession
    own = [F.struct(*docs.columns).alias("row")] if whole_rows else []
    row = ["row"] if whole_rows else []
    sized = docs.select(
        F.col(id_column).alias("doc_id"),
        F.col(source_column).alias("_source"),
        word_count(F.col(text_column)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_column), F.col(text_column)).alias("_order"),
        *own,
    )
    if not whole_rows:  # a few numbers a document: read the texts once
        sized = shared_table(sized, "sizes")
    totals = sized.groupBy("_source").agg(
        F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs")
    )
    # whole rows need not meet by source: quotas are sent to them, unless there are very many sources
    plan = broadcast_if_small(shared_table(source_quotas(totals, weights, most, block_words), "quotas"))
    dealt = (
        sized.alias("d")
        .join(plan.alias("p"), F.col("d._source").eqNullSafe(F.col("p._source")))
        .select(
            "d.doc_id", "d.size", "d._order", "p.source_size", "p.target", "p._quota", "p._number",
            *[f"d.{c}" for c in row],
            F.pmod(
                F.xxhash64(F.col("d._order"), F.lit(seed)),
                F.greatest(F.lit(1), F.ceil(F.col("p.docs") / shard_docs)),
            ).alias("_shard"),
        )
    )
    shards = dealt.groupBy("_number", "_shard").agg(
        F.sum("size").alias("_words"), F.max("_quota").alias("seats")
    )
    shards = shards.withColumn("_blocks", F.ceil(F.col("_words") / block_words))
    quotas = apportion(
        shards.withColumn("weight", F.col("_blocks").cast("double")).withColumn("most", F.col("_blocks") * most),
        "_number", "_shard",
    ).select("_number", "_shard", "_words", "_blocks", F.col("given").alias("_quota"))
    # places come first: the join that follows keeps to their shuffle, so whole rows move once
    begin = F.sum("size").over(
        Window.partitionBy("_number", "_shard")
        .orderBy("_order", "doc_id")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = dealt.drop("_quota").withColumn("_begin", begin - F.col("size"))
    placed = placed.join(quotas, ["_number", "_shard"])
    return placed.select(
        "doc_id", "size", "source_size", "target", taken(seed).alias("taken"), *row
    )


def taken(seed: int) -> Column:
    """Words of a document in the blocks that its shard takes.

    Block i holds the words from floor(i * words / blocks). Every block is taken in each of the
    quota's whole rounds; the rest of the quota are the blocks from a seeded one on, going on
    from the first after the last. As the documents lie in a seeded order, this is a seeded
    choice of documents, and all but those at its two ends are taken whole.
    """

    def overlap(begin: str, end: str) -> str:
        return (
            f"greatest(0L, least(_begin + size, ({end}) * _words DIV _blocks)"
            f" - greatest(_begin, ({begin}) * _words DIV _blocks))"
        )

    first = f"pmod(xxhash64({seed}, _number, _shard), _blocks)"
    last = f"{first} + _quota % _blocks"
    return F.expr(
        f"""CASE WHEN size = 0 THEN 0L ELSE
            (_quota DIV _blocks) * size
            + {overlap(first, f"least({last}, _blocks)")}
            + {overlap("0L", f"greatest(0L, {last} - _blocks)")}
        END"""
    ).cast("long")


def mix_documents(docs: DataFrame, **settings) -> DataFrame:
    """The documents that the mix takes, all columns, each as often as it is taken.

    Times are rounded: a document at the end of a shard's choice, taken in part, stays whole
    if at least half of it is taken. Documents without words are in no block, and go.
    """
    mixed = mixture(docs, whole_rows=True, **settings)
    times = F.round(F.col("taken") / F.col("size")).cast("int")
    return (
        mixed.select("row", times.alias("times"))
        .where("times > 0")
        .select("row", F.explode(F.sequence(F.lit(1), "times")))
        .select("row.*")
    )
