"""Star schema: three dimensions with dense keys, the fact table, and the way back.

Everything but the records' own rows comes from one count over the natural keys and the day: the
dimensions, their numbering, and figures over the whole star.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from declarium.functions.dates import date_key, month_name, month_text
from declarium.operators.scale import (
    broadcast_if_small,
    dense_positions,
    fixed,
    is_small,
    row_bytes,
)
from declarium.schema import FACT_COLUMNS, INCIDENT_COLUMNS, LOCATION_COLUMNS

DAY = "_day"
LOCATION, INCIDENT, DATE = "location", "incident", "date"


def require_columns(df: DataFrame, names: list[str]) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"Missing columns: {', '.join(missing)}")


def date_columns(day: Column) -> list[Column]:
    return [
        date_key(day).alias("dateKey"),
        day.alias("fullDate"),
        F.year(day).alias("year"),
        F.month(day).alias("month"),
        month_name(day).alias("monthName"),
        F.quarter(day).alias("quarter"),
        month_text(day).alias("monthYear"),
    ]


def dim_date(records: DataFrame, date: str = "declarationDate") -> DataFrame:
    """One row per day with records."""
    require_columns(records, [date])
    days = records.select(F.col(date).cast("date").alias(DAY)).where(F.col(DAY).isNotNull())
    return days.dropDuplicates().select(*date_columns(F.col(DAY)))


@dataclass(frozen=True)
class Star:
    """The dimensions, and the records counted by their natural keys and day (``n``).

    Dimensions found small carry the hint that they may be sent to every task.
    """

    counted: DataFrame
    dates: DataFrame
    locations: DataFrame
    incident_types: DataFrame


def build(
    records: DataFrame,
    location: list[str] | None = None,
    incident: list[str] | None = None,
    date: str = "declarationDate",
) -> Star:
    """All dimensions from one scan of the records.

    Records are counted by all natural keys and the day together, once. The grouping sets then
    copy only that count. Each dimension is numbered from 1 in the order of its natural keys, NULLs
    first: by one task if it is found small, else over a sort.
    """
    if location is None:
        location = [name for name in LOCATION_COLUMNS if name in records.columns]
    if incident is None:
        require_columns(records, ["incidentType"])
        incident = [name for name in INCIDENT_COLUMNS if name in records.columns]
    require_columns(records, [*location, *incident, date])
    counted = fixed(
        records.withColumn(DAY, F.col(date).cast("date"))
        .groupBy(*location, *incident, DAY)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    kinds = {LOCATION: location, INCIDENT: incident, DATE: [DAY]}
    distinct = fixed(distinct_keys(counted, kinds))
    sizes = distinct.groupBy("_kind").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(row_bytes(distinct)).alias("bytes")
    )
    small = {row._kind for row in sizes.collect() if is_small(row.rows, row.bytes)}

    def dimension(kind: str, key: str) -> DataFrame:
        found = distinct.where(F.col("_kind") == kind)
        order = [F.col(f"`{name}`").asc_nulls_first() for name in kinds[kind]]
        if kind in small:  # so many rows fit a task
            found = found.withColumn("_key", F.row_number().over(Window.partitionBy("_kind").orderBy(*order)))
        else:
            found = dense_positions(found, order, "_key").withColumn("_key", F.col("_key") + 1)
        names = [F.col(f"`{name}`") for name in kinds[kind]]
        found = found.select(F.col("_key").cast("long").alias(key), *names)
        return F.broadcast(found) if kind in small else found

    days = distinct.where((F.col("_kind") == DATE) & F.col(DAY).isNotNull())
    days = days.select(*date_columns(F.col(DAY)))
    return Star(
        counted,
        F.broadcast(days) if DATE in small else days,
        dimension(LOCATION, "locationKey"),
        dimension(INCIDENT, "incidentTypeKey"),
    )


def distinct_keys(counted: DataFrame, kinds: dict[str, list[str]]) -> DataFrame:
    """Distinct keys of every kind in one table: _kind and all columns, null where not of the kind."""
    names = [name for columns in kinds.values() for name in columns]
    sets = [[F.col(f"`{name}`") for name in columns] for columns in kinds.values()]
    # grouping_id has a bit for every column that a set leaves out, the first column's on top
    whole = (1 << len(names)) - 1
    kind = F.lit(None).cast("string")
    for name, columns in kinds.items():
        held = sum(1 << (len(names) - 1 - names.index(c)) for c in columns)
        kind = F.when(F.col("_set") == whole - held, name).otherwise(kind)
    distinct = counted.groupingSets(sets, *[F.col(f"`{name}`") for name in names]).agg(
        F.grouping_id().alias("_set")
    )
    return distinct.withColumn("_kind", kind).drop("_set")


def keyed_dimension(records: DataFrame, natural: list[str], key: str) -> DataFrame:
    """Distinct natural keys numbered 1, 2, … in their own order, NULLs first."""
    distinct = records.select(*natural).dropDuplicates()
    order = [F.col(name).asc_nulls_first() for name in natural]
    numbered = dense_positions(distinct, order, key)
    return numbered.select((F.col(key) + 1).alias(key), *natural)


def dim_location(records: DataFrame) -> DataFrame:
    natural = [name for name in LOCATION_COLUMNS if name in records.columns]
    return keyed_dimension(records, natural, "locationKey")


def dim_incident_type(records: DataFrame) -> DataFrame:
    require_columns(records, ["incidentType"])
    natural = [name for name in INCIDENT_COLUMNS if name in records.columns]
    return keyed_dimension(records, natural, "incidentTypeKey")


def add_key(
    records: DataFrame,
    dimension: DataFrame,
    natural: list[str],
    key: str,
    checked: bool = False,
) -> DataFrame:
    """The dimension's key on every record; a missing natural key finds the missing one."""
    found = dimension.select(key, *[F.col(name).alias(f"_{name}") for name in natural])
    same = [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in natural]
    found = found if checked else broadcast_if_small(found)
    return records.join(found, same, "left").drop(*[f"_{name}" for name in natural])


def fact(
    records: DataFrame,
    locations: DataFrame,
    incident_types: DataFrame,
    wanted: list[str] = FACT_COLUMNS,
    date: str = "declarationDate",
    checked: bool = False,
) -> DataFrame:
    """One row per record with its date, location and incident-type keys.

    ``checked`` dimensions are joined as they come, with their hints; others are counted first.
    """
    keyed = records.withColumn("dateKey", date_key(F.col(date)))
    for dimension, key in [(locations, "locationKey"), (incident_types, "incidentTypeKey")]:
        natural = [name for name in dimension.columns if name != key]
        keyed = add_key(keyed, dimension, natural, key, checked)
    return keyed.select([name for name in wanted if name in keyed.columns])


def counted_facts(star: Star) -> DataFrame:
    """The fact table counted: dateKey, locationKey, incidentTypeKey and n records."""
    keys = ["dateKey", "locationKey", "incidentTypeKey", "n"]
    return fact(star.counted, star.locations, star.incident_types, keys, DAY, checked=True)


def denormalise(
    facts: DataFrame,
    dates: DataFrame,
    locations: DataFrame,
    incident_types: DataFrame,
    checked: bool = False,
) -> DataFrame:
    """Fact joined to its three dimensions; facts without a date stay."""
    sent = (lambda df: df) if checked else broadcast_if_small
    return (
        facts.join(sent(dates), "dateKey", "left")
        .join(sent(locations), "locationKey", "left")
        .join(sent(incident_types), "incidentTypeKey", "left")
    )
