"""Monthly series per region, without gaps."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from declarium.functions.dates import month_floor, month_start, months_between
from declarium.schema import NOT_REPORTED, Columns


def forecast_cube(records: DataFrame, as_of: date | str, columns: Columns = Columns()) -> DataFrame:
    """Completed history counted per region, month, category and place.

    The only step of the forecast that reads the records. Map-side counting shrinks them
    before the shuffle, however unevenly regions share them; what follows works on this
    table, whose size depends on the calendar and the number of places, not on the records.
    """
    when = F.col(columns.date)
    usable = records.where(
        F.col(columns.group).isNotNull()
        & (F.col(columns.group) != NOT_REPORTED)
        & (when < F.lit(month_floor(as_of)))
    )
    return usable.groupBy(
        F.col(columns.group).alias("region"),
        month_start(when).alias("month"),
        F.col(columns.category).alias("category"),
        F.col(columns.geo).alias("geo"),
    ).agg(F.count(F.lit(1)).alias("n"))


def monthly_counts(
    records: DataFrame, as_of: date | str, columns: Columns = Columns()
) -> DataFrame:
    """Records per region and completed month, only months with records."""
    when = F.col(columns.date)
    usable = records.where(
        F.col(columns.group).isNotNull()
        & (F.col(columns.group) != NOT_REPORTED)
        & (when < F.lit(month_floor(as_of)))
    )
    return usable.groupBy(
        F.col(columns.group).alias("region"), month_start(when).alias("month")
    ).agg(F.count(F.lit(1)).alias("n"))


def dense_series(counts: DataFrame) -> DataFrame:
    """Every month from a region's first to its last one with records; zero in the gaps.

    Columns: region, month, n, position (0 = first) and months (length of the series). Each
    counted month also produces the empty months up to the next one, so filling needs no
    calendar table and no join: one shuffle by region.
    """
    by_region = Window.partitionBy("region")
    in_order = by_region.orderBy("month")
    bounds = counts.select(
        "region",
        "n",
        F.col("month").alias("counted"),
        F.coalesce(F.add_months(F.lead("month").over(in_order), -1), "month").alias("until"),
        F.min("month").over(by_region).alias("first"),
        F.max("month").over(by_region).alias("last"),
    )
    filled = bounds.withColumn(
        "month", F.explode(F.sequence("counted", "until", F.expr("INTERVAL 1 MONTH")))
    )
    return filled.select(
        "region",
        "month",
        F.when(F.col("month") == F.col("counted"), F.col("n")).otherwise(0).alias("n"),
        months_between(F.col("month"), F.col("first")).alias("position"),
        (months_between(F.col("last"), F.col("first")) + 1).alias("months"),
    )


def monthly_series(
    records: DataFrame, as_of: date | str, columns: Columns = Columns()
) -> DataFrame:
    return dense_series(monthly_counts(records, as_of, columns))
