"""Record filters."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from declarium.functions.dates import as_date
from declarium.schema import LISTING_COLUMNS, Columns


def require_range(name: str, value: int, low: int, high: int | None = None) -> int:
    if value < low or (high is not None and value > high):
        raise ValueError(f"{name} must be {low} or more" + (f", at most {high}" if high else ""))
    return value


def year_bounds(start_year: int, end_year: int) -> tuple[date, date]:
    """First and last day of a range of years, as date bounds so that they reach the scan."""
    return date(start_year, 1, 1), date(max(start_year, end_year), 12, 31)


def apply_filters(
    records: DataFrame,
    columns: Columns = Columns(),
    start: date | str | None = None,
    end: date | str | None = None,
    geos: Iterable[str] = (),
    groups: Iterable[str] = (),
    categories: Iterable[str] = (),
    type_labels: Iterable[str] = (),
) -> DataFrame:
    """Records dated from ``start`` to the end of the day ``end`` with the chosen values.

    An omitted bound is open, which selects the same rows as the table's own first or last
    date; undated records never pass. A start behind the table's last date, without an end, selects
    nothing here; ``date_range`` is where that is an error. An empty selection does not filter.
    Every condition is on a plain column, so a columnar source can skip row groups; tables written
    in folders by year also get bounds on the year, so that whole folders are skipped.
    """
    start = as_date(start) if start is not None else None
    end = as_date(end) if end is not None else None
    if start and end and start > end:
        raise ValueError("The start date must not be after the end date.")
    when = F.col(columns.date)
    result = records.where(when.isNotNull())
    by_year = {"year", "declarationYear"} <= set(records.columns)  # a table in folders by year
    if start:
        result = result.where(when >= F.lit(start))
        result = result.where(F.col("year") >= start.year) if by_year else result
    if end:
        result = result.where(when < F.lit(end + timedelta(days=1)))
        result = result.where(F.col("year") <= end.year) if by_year else result
    selections = [
        (columns.geo, geos),
        (columns.group, groups),
        (columns.category, categories),
        (columns.type_label, type_labels),
    ]
    for column, chosen in selections:
        chosen = list(chosen)
        if chosen:
            result = result.where(F.col(column).isin(chosen))
    return result


def date_range(
    records: DataFrame,
    columns: Columns = Columns(),
    start: date | str | None = None,
    end: date | str | None = None,
) -> DataFrame:
    """The bounds a request resolves to, and the number of dated records in the table.

    A first bound after the last one, given or of the table, is an error.
    """
    if start and end and as_date(start) > as_date(end):
        raise ValueError("The start date must not be after the end date.")
    message = F.lit("The start date must not be after the end date.")
    first, last = F.min(columns.date).cast("date"), F.max(columns.date).cast("date")
    return records.agg(
        (F.lit(as_date(start)) if start else first).alias("start_date"),
        (F.lit(as_date(end)) if end else last).alias("end_date"),
        F.count(columns.date).alias("dated_records"),
    ).where(F.col("start_date").isNotNull() & F.col("end_date").isNotNull()).withColumn(
        "end_date",
        F.when(F.col("start_date") <= F.col("end_date"), F.col("end_date")).otherwise(
            F.raise_error(message).cast("date")
        ),
    )


def listing(records: DataFrame, wanted: list[str] = LISTING_COLUMNS) -> DataFrame:
    """The wanted columns that exist, in their order."""
    return records.select([name for name in wanted if name in records.columns])


def newest_first(records: DataFrame, columns: Columns = Columns()) -> DataFrame:
    """Whole table by date, newest first; only worth its sort right before a sink."""
    return records.orderBy(F.col(columns.date).desc_nulls_last(), F.col(columns.id))
