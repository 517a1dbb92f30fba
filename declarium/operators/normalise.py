"""From raw text records to typed, labelled, deduplicated records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from declarium.functions.dates import month_name, month_text, parse_utc
from declarium.functions.numbers import whole_number
from declarium.functions.text import (
    clean_texts,
    code_label,
    or_not_reported,
    region_label,
    title_case,
)
from declarium.schema import (
    DATE_COLUMNS,
    FILLED_COLUMNS,
    INTEGER_COLUMNS,
    NORMALISED_COLUMNS,
    REQUIRED_COLUMNS,
    TEXT_COLUMNS,
    TYPE_LABELS,
)


def ensure_columns(df: DataFrame, names: list[str], data_type: str = "string") -> DataFrame:
    """Add the columns that are missing, all NULL."""
    missing = [name for name in names if name not in df.columns]
    return df.withColumns({name: F.lit(None).cast(data_type) for name in missing})


def typed(raw: DataFrame) -> DataFrame:
    """Parse dates and integers and clean the text columns that exist."""
    parsed: dict[str, Column] = {}
    types = dict(raw.dtypes)
    for name in raw.columns:
        if name in DATE_COLUMNS and types[name] == "string":
            parsed[name] = parse_utc(F.col(name))
        elif name in DATE_COLUMNS:
            parsed[name] = F.col(name).cast("timestamp_ntz")
        elif name in INTEGER_COLUMNS and types[name] == "string":
            parsed[name] = whole_number(F.col(name))
    texts = [name for name in TEXT_COLUMNS if name in raw.columns]
    return clean_texts(raw.withColumns(parsed), texts)


def standard_case(df: DataFrame) -> DataFrame:
    """Codes in capitals, names in title case."""
    return df.withColumns(
        {
            "state": F.upper("state"),
            "declarationType": F.upper("declarationType"),
            "incidentType": title_case(F.col("incidentType")),
            "designatedArea": title_case(F.col("designatedArea")),
        }
    )


def with_date_parts(df: DataFrame, date: str = "declarationDate") -> DataFrame:
    when = F.col(date)
    return df.withColumns(
        {
            "declarationYear": F.year(when),
            "declarationMonth": F.month(when),
            "declarationMonthName": month_name(when),
            "declarationQuarter": F.quarter(when),
            "declarationMonthYear": month_text(when),
        }
    )


def latest_per_id(df: DataFrame, id_column: str, order: list[Column]) -> DataFrame:
    """One row per id, the last in the given order; rows without an id count as one id.

    The rank is cut to one before the shuffle too (a window group limit), so an id that
    holds a large part of the rows sends one row per task, not all of them, to its task.
    """
    newest = Window.partitionBy(id_column).orderBy(*[column.desc_nulls_last() for column in order])
    ranked = df.withColumn("_rank", F.row_number().over(newest))
    return ranked.where(F.col("_rank") == 1).drop("_rank")


def drop_repeats(df: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """By id where ids exist, else whole rows. Without an order the last refresh wins."""
    if "id" not in df.columns or df.where(F.col("id").isNotNull()).isEmpty():
        return df.dropDuplicates()
    if order is None:
        order = [F.col("lastRefresh")] if "lastRefresh" in df.columns else []
        order = [*order, F.xxhash64(*df.columns)]
    return latest_per_id(df, "id", order)


def clean(raw: DataFrame) -> DataFrame:
    """The cleaned table: raw columns typed and cased, six derived columns, no equal rows."""
    df = standard_case(typed(ensure_columns(raw, REQUIRED_COLUMNS)))
    df = with_date_parts(df).withColumn("femaRegion", region_label(F.col("region")))
    return df.dropDuplicates()


def normalise(raw: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """The flat table behind every figure: typed, labelled, one row per id, 34 columns.

    ``order`` says which row of an id is the last one; a file's own row order does not
    exist in a distributed table.
    """
    df = standard_case(typed(ensure_columns(raw, REQUIRED_COLUMNS)))
    df = with_date_parts(df).withColumns(
        {
            "declarationTypeLabel": code_label(F.col("declarationType"), TYPE_LABELS),
            "femaRegion": region_label(F.col("region")),
        }
    )
    filled = [name for name in FILLED_COLUMNS if name in df.columns]
    df = df.withColumns({name: or_not_reported(F.col(name)) for name in filled})
    df = drop_repeats(df, order)
    return df.select([name for name in NORMALISED_COLUMNS if name in df.columns])
