"""Writers: tables between stages, guarded outputs, and CSV exports."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession, Window
from pyspark.sql import functions as F

from declarium.operators.filters import listing, newest_first
from declarium.operators.forecast import in_region_order
from declarium.operators.sampling import head
from declarium.schema import FORECAST_EXPORT_COLUMNS, LISTING_COLUMNS, YEAR_FOLDER, Columns


def publish(spark: SparkSession, new: str, path: str) -> None:
    """Put a finished folder in the place of ``path``; what stood there is removed last.

    Until the new folder stands there, the old one can be put back, and is if that fails.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target, source, aside = hadoop(path), hadoop(new), hadoop(f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had_one = files.exists(target)
    if not files.exists(source) or (had_one and not files.rename(target, aside)):
        raise OSError(f"Could not replace {path}")
    published = False
    try:
        published = files.rename(source, target)
    finally:
        if not published and had_one:
            files.rename(aside, target)
    if not published:
        raise OSError(f"Could not publish {path}")
    if had_one:
        files.delete(aside, True)


def replace_folder(df: DataFrame, path: str, save: Callable[[DataFrameWriter, str], None]) -> str:
    """Write beside the folder and publish at the end; a failed write leaves the old table as it is."""
    spark, new = df.sparkSession, f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    try:
        save(df.write, new)
        publish(spark, new, path)
    except BaseException:
        begun = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(new)
        begun.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(begun, True)
        raise
    return path


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Parquet, so that types survive to the next stage."""

    def save(writer: DataFrameWriter, new: str) -> None:
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(new)

    return replace_folder(df, path, save)


def write_csv(df: DataFrame, path: str) -> str:
    """CSV with a header; as many files as the data has partitions. Blanks around texts stay."""
    options = {
        "header": True, "escape": '"', "ignoreLeadingWhiteSpace": False,
        "ignoreTrailingWhiteSpace": False,
    }
    return replace_folder(df, path, lambda writer, new: writer.options(**options).csv(new))


def write_newest_first(records: DataFrame, path: str, columns: Columns = Columns()) -> str:
    """The whole table by date, newest first, in files whose names keep the order.

    Ranges of (date, id) become files, each sorted; a day with a large part of the records is cut
    by id. Whoever reads the files one after the other has the order without sorting.
    """
    return write_table(newest_first(records, columns), path)


def in_file_order(spark: SparkSession, path: str, name: str = "position") -> DataFrame:
    """A sorted table with the place of every row, from file names and the rows' places in them.

    Nothing is sorted: one small row a file says how many rows stand before it. A range of places
    is read from the files that hold it alone.
    """
    rows = spark.read.parquet(path).select(
        "*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row")
    )
    sizes = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_file", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    placed = rows.join(F.broadcast(starts), "_file")
    return placed.withColumn(name, F.col("_start") + F.col("_row")).drop("_file", "_row", "_start")


def write_records(records: DataFrame, path: str) -> str:
    """The normalised table in one folder per year, so that date filters skip folders.

    The rebalance hint gathers each year into files of a good size and splits a year that
    holds most of the records over several tasks.
    """
    by_year = records.withColumn(YEAR_FOLDER, F.col("declarationYear")).hint("rebalance", YEAR_FOLDER)
    return write_table(by_year, path, [YEAR_FOLDER])


def write_full(records: DataFrame, path: str, is_sample: bool) -> str | None:
    """The full table by year, or nothing at all if the records are only a sample.

    A full table left by an earlier run is emptied then: it must not pass for the result of
    this one. Only ``path`` itself, an output of this library, is ever overwritten.
    """
    if is_sample:
        write_table(records.limit(0), path)
        return None
    return write_records(records, path)


def write_review_sample(df: DataFrame, order: list[Column], path: str, n: int = 1000) -> str:
    return write_csv(head(df, order, n).coalesce(1), path)


def export_listing(filtered: DataFrame, path: str) -> str:
    """The record listing of a filter, eight columns."""
    return write_csv(listing(filtered, LISTING_COLUMNS), path)


def export_forecast(
    forecast: DataFrame, path: str, wanted: list[str] | None = FORECAST_EXPORT_COLUMNS
) -> str:
    """Forecast rows in region order, months as ``YYYY-MM-DD``; ``wanted=None``: all columns.

    Region months are few, so one file is enough.
    """
    dated = forecast.withColumn("month", F.date_format("month", "yyyy-MM-dd"))
    chosen = dated if wanted is None else dated.select(wanted)
    return write_csv(in_region_order(chosen).coalesce(1), path)
