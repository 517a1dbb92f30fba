"""What the operators of this package share: Arrow mapping, shared tables, the learning fold."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import declarium
from declarium.operators.scale import checkpoint_folder

# Documents whose crc32(doc_id) leaves this remainder by 5 are held out of all learning.
FOLDS, HELD_OUT_FOLD = 5, 0


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the held-out fold; rows without an id are held out, so nothing is learned from them."""
    fold = F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == HELD_OUT_FOLD, F.lit(True))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that the cluster names in spark.checkpoint.dir."""
    checkpoint_folder(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Written once as Parquet to the shared folder and read back.

    Cuts the lineage: what follows reads files that every executor sees, so a lost executor
    costs only its running tasks, and several readers never repeat the work before.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# What an operator keeps in a worker from task to task, by its module.
CACHES: dict[str, dict] = {}


def make_room(module: str) -> None:
    """Drop what other operators keep here: workers go on from stage to stage, and from job to job."""
    others = [cache for name, cache in CACHES.items() if name != module and cache]
    for cache in others:
        cache.clear()
    if others:
        give_back()


def give_back() -> None:
    """Return freed memory to the system: a worker that waits for its next task counts as well."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_arrow(
    df: DataFrame, function: Callable[[pa.RecordBatch], dict | None], schema: str
) -> DataFrame:
    """Apply a function from an Arrow batch to a dict of columns, batch by batch.

    Batches are bounded in rows and bytes by Spark's Arrow settings; nothing is kept
    between them but what the function caches within its own documented bound.
    """
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(function.__module__)
        for batch in batches:
            if batch.num_rows:
                columns = function(batch)
                if columns is not None:
                    yield pa.RecordBatch.from_arrays(
                        [
                            c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c)
                            for c in (columns[n] for n in names)
                        ],
                        names=names,
                    )
        give_back()

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def ids_of(batch: pa.RecordBatch, name: str = "doc_id") -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``size`` bytes of text each, or one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy())
    edges = [0, *(np.flatnonzero(np.diff(ends // size)) + 1).tolist(), batch.num_rows]
    for low, high in zip(edges, edges[1:]):
        yield batch.slice(low, high - low)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, for clusters that lack it."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        home = Path(declarium.__file__).parent
        archive = Path(tempfile.mkdtemp(prefix="declarium-")) / "declarium_package.zip"
        with zipfile.ZipFile(archive, "w") as packed:
            for path in sorted(home.rglob("*.py")):
                packed.write(path, path.relative_to(home.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)
