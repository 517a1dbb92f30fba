"""Exact top-k by inner product with vector-approximation files.

Every vector is stored twice: as cells, a byte a component that tells between which two
boundaries it lies, and exactly. A query first scans the cells, which bound its score with every
vector from above; then it reads exact vectors in the order of these bounds until the k-th best
exact score is beyond the bound of the next one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 256
K = 5
QUERY_EVERY = 50
CELLS = 64
# Vectors and queries of one block of the search: what a task holds at once.
BLOCK_VECTORS = 8_192
BLOCK_QUERIES = 2_048
# Exact vectors read at a time.
STEP = 64


def taking_part(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """vec_id and vector (doubles) of the rows with an id and none but finite components."""
    vector = F.transform(F.col(vector_column), lambda x: x.cast("double"))
    # infinity minus itself is NaN, and so is NaN: only finite components leave 0
    finite = F.forall(vector, lambda x: F.coalesce((x - x) == 0, F.lit(False)))
    return (
        vectors.where(F.col(vector_column).isNotNull() & F.col(id_column).isNotNull())
        .where((F.size(vector_column) > 0) & finite)
        .select(F.col(id_column).cast("long").alias("vec_id"), vector.alias("vector"))
    )


def scaled(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """id and integer components; an error if a score of two of the vectors may not fit 64 bits."""
    found = taking_part(vectors, id_column, vector_column)
    largest, width = found.agg(
        F.max(F.array_max(F.transform("vector", lambda x: F.abs(x)))), F.max(F.size("vector"))
    ).first()
    if largest is not None and (scale * largest + 1) ** 2 * width >= 2.0**62:
        raise ValueError(f"Components up to {largest:g} make scores beyond 64 bits.")
    return found.withColumn("vector", F.transform("vector", lambda x: F.floor(x * scale).cast("long")))


def approximate(vectors: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """Cell numbers, and the boundaries of every component's cells: quantiles of the block.

    A component in cell c lies from boundary c to boundary c + 1, both included.
    """
    places = np.linspace(0, len(vectors) - 1, cells + 1).round().astype(int)
    bounds = np.sort(vectors, axis=0)[places]
    numbers = np.stack(
        [
            np.clip(np.searchsorted(bounds[:, d], vectors[:, d], "right") - 1, 0, cells - 1)
            for d in range(vectors.shape[1])
        ],
        axis=1,
    )
    return numbers.astype(np.uint8), bounds


def upper_bounds(query: np.ndarray, numbers: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For every vector, a score that its score with the query does not exceed."""
    low, high = bounds[:-1] * query, bounds[1:] * query
    largest = np.maximum(low, high)  # by cell and component
    return largest[numbers, np.arange(numbers.shape[1])].sum(axis=1)


def search_block(
    vec_ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int
) -> list[tuple[int, int, int]]:
    """The k best (query, vector, score) of a block for every query; ties to smaller ids."""
    numbers, bounds = approximate(vectors)
    out = []
    for query_id, query in zip(query_ids.tolist(), queries):
        most = upper_bounds(query, numbers, bounds)
        most[vec_ids == query_id] = np.iinfo(np.int64).min // 2  # never its own neighbour
        candidates = int((vec_ids != query_id).sum())
        ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        read, ready = 0, max(4 * STEP, 8 * k)
        order = np.argpartition(-most, min(ready, len(most) - 1))[:ready]
        order = order[np.argsort(-most[order], kind="stable")]
        while read < candidates:
            if read >= len(order):  # the first few were not enough: all others, by bound
                unread = np.ones(len(most), bool)
                unread[order] = False
                rest = np.flatnonzero(unread)
                order = np.concatenate([order, rest[np.argsort(-most[rest], kind="stable")]])
            # a vector with a bound equal to the k-th score may tie with a smaller id
            if len(scores) == k and most[order[read]] < scores[-1]:
                break
            step = order[read : min(read + STEP, candidates)]
            read += len(step)
            ids = np.concatenate([ids, vec_ids[step]])
            scores = np.concatenate([scores, vectors[step] @ query])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
        out += [(query_id, int(i), int(s)) for i, s in zip(ids, scores)]
    return out


def exact_top_k(
    vectors: DataFrame,
    queries: DataFrame | None = None,
    k: int = K,
    scale: int = SCALE,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    block_vectors: int = BLOCK_VECTORS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """query_id, rank, vec_id, score: every query's k best vectors, fewer if there are fewer.

    By default the queries are the rows whose id is divisible by QUERY_EVERY. Components become
    floor(scale * x); scores are inner products of integers. Rows without an id, and vectors
    that are null, empty or hold a null, NaN or infinite component, take no part; neither do
    vectors of another size than the query's. Every row but those of the query's id is a candidate,
    equal rows one each; equal rows ask once, and an id with several vectors asks with all of them
    for one list. Scores are 64-bit numbers: components so large that a score might not fit are an
    error. Only id and vector are read.

    Vectors and queries are dealt to blocks by a hash of id and vector; every pair of blocks is one
    bounded group, and its best are merged by query. A query block is sent to each vector
    block and the other way round, never more than that.
    """
    found = scaled(vectors, id_column, vector_column, scale)
    asked = (
        found.where(F.col("vec_id") % QUERY_EVERY == 0)
        if queries is None
        else scaled(queries, id_column, vector_column, scale)
    )
    rows, questions = found.agg(
        F.count(F.lit(1)), F.count(F.when(F.col("vec_id") % QUERY_EVERY == 0, 1))
    ).first()
    if queries is not None:
        questions = asked.count()
    # no more than k copies of a row can be among the k best
    copies = F.least(F.count(F.lit(1)), F.lit(k)).cast("int")
    found = found.groupBy("vec_id", "vector").agg(copies.alias("copies"))
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    rows_in, query_blocks = max(1, -(-rows // block_vectors)), max(1, -(-questions // block_queries))

    def blocks(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        place = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(n_own)).cast("int")
        return df.select(
            "vec_id", "vector", F.size("vector").alias("width"), place.alias(own)
        ).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    left = blocks(found, "v", rows_in, "q", query_blocks)
    right = blocks(asked.distinct(), "q", query_blocks, "v", rows_in)

    def search(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        matrix, ids = np.stack(vectors["vector"].to_list()), vectors["vec_id"].to_numpy()
        questions, asked = np.stack(queries["vector"].to_list()), queries["vec_id"].to_numpy()
        best = search_block(ids, matrix, asked, questions, k)
        return pd.DataFrame(best, columns=["query_id", "vec_id", "score"], dtype="int64")

    best = (
        left.groupBy("width", "v", "q")
        .cogroup(right.groupBy("width", "v", "q"))
        .applyInPandas(search, "query_id long, vec_id long, score long")
    )
    # at most k rows a query and vector block: a list of these is short
    ranked = best.groupBy("query_id").agg(
        F.slice(
            F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k
        ).alias("best")
    )
    return ranked.select("query_id", F.posexplode("best").alias("place", "hit")).select(
        "query_id",
        (F.col("place") + 1).cast("int").alias("rank"),
        F.col("hit.vec_id").alias("vec_id"),
        (-F.col("hit.s")).alias("score"),
    )
