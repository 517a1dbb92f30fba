"""Counts, rankings, trends and key figures.

Each function counts rows, or sums the column ``weight`` if given: the same calls then run
on a table that is already counted (see ``record_cube``) instead of on the records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from declarium.functions.dates import month_name, month_start, month_text
from declarium.functions.text import region_order
from declarium.operators.filters import require_range
from declarium.schema import MONTH_NAMES, NOT_REPORTED, SEASONS, Columns

RECORDS = "declaration_records"


def tally(weight: str | None) -> Column:
    return F.count(F.lit(1)) if weight is None else F.sum(weight)


def tally_if(condition: Column, weight: str | None) -> Column:
    if weight is None:
        return F.count_if(condition)
    return F.coalesce(F.sum(F.when(condition, F.col(weight))), F.lit(0))


def leading(n: Column, key: Column, among: Column | None = None) -> Column:
    """Aggregate: the key with the largest n as a struct (minus, key); ties: the smaller key."""
    wanted = key.isNotNull() if among is None else key.isNotNull() & among
    return F.min(F.when(wanted, F.struct((-n).alias("minus"), key.alias("key"))))


def count_by(
    records: DataFrame, keys: dict[str, Column], weight: str | None = None, name: str = RECORDS
) -> DataFrame:
    """Records per combination of keys; a missing key belongs to no combination."""
    named = [expression.alias(alias) for alias, expression in keys.items()]
    extra = [F.col(weight)] if weight else []
    return (
        records.select(*named, *extra)
        .dropna(subset=list(keys))
        .groupBy(*keys)
        .agg(tally(weight).alias(name))
    )


def ranking(counts: DataFrame, limit: int | None = None, name: str = RECORDS) -> DataFrame:
    """Largest first; equal counts by key, so that the result repeats."""
    keys = [column for column in counts.columns if column != name]
    ordered = counts.orderBy(F.col(name).desc(), *keys)
    return ordered if limit is None else ordered.limit(limit)


def top_values(
    records: DataFrame, column: str, limit: int = 10, weight: str | None = None
) -> DataFrame:
    require_range("limit", limit, 1, 50)
    return ranking(count_by(records, {"name": F.col(column)}, weight), limit)


def top_reported(
    records: DataFrame, column: str, limit: int = 5, weight: str | None = None
) -> DataFrame:
    """The top values less "Not Reported", taken out after the cut as in the key findings."""
    return top_values(records, column, limit, weight).where(F.col("name") != NOT_REPORTED)


def top_pairs(
    records: DataFrame,
    limit: int = 25,
    columns: Columns = Columns(),
    weight: str | None = None,
    name: str = RECORDS,
) -> DataFrame:
    """Most frequent pairs of place and category."""
    keys = {columns.geo: F.col(columns.geo), columns.category: F.col(columns.category)}
    return ranking(count_by(records, keys, weight, name), limit, name)


def region_counts(
    records: DataFrame, columns: Columns = Columns(), weight: str | None = None
) -> DataFrame:
    """Records per region in region order, without "Not Reported"."""
    reported = records.where(F.col(columns.group) != NOT_REPORTED)
    counts = count_by(reported, {"name": F.col(columns.group)}, weight)
    return counts.orderBy(region_order(F.col("name")), "name")


def trend(
    records: DataFrame,
    grain: str = "year",
    columns: Columns = Columns(),
    weight: str | None = None,
) -> DataFrame:
    """Records per year or per ``YYYY-MM``, oldest first."""
    periods = {
        "year": F.year(columns.date).cast("string"),
        "month": month_text(F.col(columns.date)),
    }
    if grain not in periods:
        raise ValueError("grain must be year or month")
    return count_by(records, {"period": periods[grain]}, weight).orderBy("period")


def month_counts(
    records: DataFrame, columns: Columns = Columns(), weight: str | None = None, name: str = RECORDS
) -> DataFrame:
    """Records per calendar month over all years; months without records are absent."""
    when = F.col(columns.date)
    keys = {"month": F.month(when), "monthName": month_name(when)}
    return count_by(records, keys, weight, name).orderBy("month")


def seasonality(
    records: DataFrame, columns: Columns = Columns(), weight: str | None = None
) -> DataFrame:
    """Records per calendar month, all twelve of them, zero where there are none."""
    month = F.month(columns.date)
    totals = records.agg(
        *[tally_if(month == number, weight).alias(f"m{number}") for number in range(1, 13)]
    )
    points = [
        F.struct(
            F.lit(number).alias("month"),
            F.lit(MONTH_NAMES[number - 1]).alias("name"),
            F.col(f"m{number}").alias(RECORDS),
        )
        for number in range(1, 13)
    ]
    return totals.select(F.inline(F.array(*points)))


def season_of(month_number: Column) -> tuple[Column, Column]:
    """Name and rank of the season a month number lies in."""
    name, rank = F.lit(None).cast("string"), F.lit(None).cast("int")
    for position, (season, months) in enumerate(SEASONS.items()):
        name = F.when(month_number.isin(months), season).otherwise(name)
        rank = F.when(month_number.isin(months), position).otherwise(rank)
    return name, rank


def season_totals(month_totals: DataFrame) -> DataFrame:
    """Totals of the four seasons, largest first, from the twelve rows of ``seasonality``."""
    name, rank = season_of(F.col("month"))
    return (
        month_totals.groupBy(name.alias("name"), rank.alias("season_order"))
        .agg(F.sum(RECORDS).alias(RECORDS))
        .orderBy(F.col(RECORDS).desc(), "season_order")
    )


def summary(
    records: DataFrame, columns: Columns = Columns(), weight: str | None = None
) -> DataFrame:
    """Key figures in one row: records, distinct entities, leading place and category, peak year.

    One scan: every task counts its records by place, category and year, and notes its distinct
    entities beside that, so that a shuffled row stands for one combination or one entity, never
    for both. What is copied for each single key is the count of the combinations alone. No row, if
    there are no records.
    """
    kinds = ["geo", "category", "year"]
    keyed = records.select(
        F.col(columns.geo).alias("geo"),
        F.col(columns.category).alias("category"),
        F.year(columns.date).alias("year"),
        F.col(columns.entity).alias("entity"),
        *([F.col(weight)] if weight else []),
    )
    sets = [[F.col(k) for k in kinds], [F.col("entity")]]
    apart = keyed.groupingSets(sets, *kinds, "entity").agg(
        tally(weight).alias("n"), (F.grouping("entity") == 0).alias("of_entity")
    )
    combined = apart.groupBy(*kinds, "of_entity").agg(
        F.sum("n").alias("n"), F.count("entity").alias("entities")
    )
    rolled = combined.groupingSets([[F.col(k), F.col("of_entity")] for k in kinds], *kinds, "of_entity").agg(
        F.sum("n").alias("n"), F.max("entities").alias("entities"),
        F.grouping_id().cast("int").alias("kind"),
    )
    # grouping_id sets the bit of each key that is rolled up: 0110, 1010, 1100.
    is_kind = {k: (F.col("kind") == 14 - (8 >> i)) & ~F.col("of_entity") for i, k in enumerate(kinds)}

    def leader(key: str) -> Column:
        return leading(F.col("n"), F.col(key), is_kind[key])["key"]

    return rolled.agg(
        F.sum(F.when(is_kind["geo"], F.col("n"))).alias(RECORDS),
        F.coalesce(F.max(F.when(F.col("of_entity"), F.col("entities"))), F.lit(0)).alias(
            "unique_disaster_numbers"
        ),
        leader("geo").alias("top_state"),
        leader("category").alias("top_incident_type"),
        leader("year").alias("peak_year"),
    ).where(F.col(RECORDS) > 0)


def metadata(records: DataFrame, columns: Columns = Columns()) -> DataFrame:
    """Every value the filters offer, as rows (field, value, position), from one scan.

    The rows ``minimum_date`` and ``maximum_date`` hold the date range. One row per value
    keeps fields with many values out of a single cell.
    """
    fields = {
        "states": F.col(columns.geo),
        "regions": F.when(F.col(columns.group) != NOT_REPORTED, F.col(columns.group)),
        "incident_types": F.col(columns.category),
        "declaration_types": F.col(columns.type_label),
        "years": F.year(columns.date).cast("string"),
    }
    day = F.col(columns.date).cast("date")
    # Grouping sets copy their input once per set, so the records are combined before them.
    keyed = (
        records.select(*[e.alias(name) for name, e in fields.items()], day.alias("day"))
        .groupBy(*fields)
        .agg(F.min("day").alias("first"), F.max("day").alias("last"))
    )
    # One set per field, and the empty set for the range over the whole table.
    sets = [[F.col(field)] for field in fields] + [[]]
    counts = keyed.groupingSets(sets, *fields).agg(
        F.grouping_id().alias("set"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    whole_table = F.col("set") == 2 ** len(fields) - 1
    values = {field: F.col(field) for field in fields} | {
        "minimum_date": F.when(whole_table, F.col("first").cast("string")),
        "maximum_date": F.when(whole_table, F.col("last").cast("string")),
    }
    pairs = [F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in values.items()]
    return (
        counts.select(F.inline(F.array(*pairs)))
        .where(F.col("value").isNotNull())
        .orderBy("field", region_order(F.col("value")), "value")
    )


def record_cube(
    records: DataFrame, columns: Columns = Columns(), name: str = "records"
) -> DataFrame:
    """Records per month, place, region, category and type: the whole dashboard in small.

    Month starts stand for the dates, so trend, rankings and seasonality on the cube (with
    ``weight="records"``) equal those on the records. Only entity counts need the records.
    """
    keys = [columns.geo, columns.group, columns.category, columns.type_label]
    return records.groupBy(
        month_start(F.col(columns.date)).alias(columns.date), *keys
    ).agg(F.count(F.lit(1)).alias(name))


def breakdowns(records: DataFrame, columns: Columns = Columns()) -> DataFrame:
    """All one-column counts (year, month, place, region, category, type) in one scan.

    The records are counted to cube grain first; only that small table meets the grouping
    sets, which would otherwise multiply every record by six.
    """
    cube = record_cube(records, columns)
    fields = {
        "year": F.year(columns.date).cast("string"),
        "month": F.lpad(F.month(columns.date).cast("string"), 2, "0"),
        "geo": F.col(columns.geo),
        "group": F.col(columns.group),
        "category": F.col(columns.category),
        "type_label": F.col(columns.type_label),
    }
    keyed = cube.select(*[e.alias(name) for name, e in fields.items()], "records")
    counts = keyed.groupingSets([[F.col(f"`{f}`")] for f in fields], *fields).agg(
        F.sum("records").alias(RECORDS)
    )
    return counts.unpivot([RECORDS], list(fields), "field", "value").where(
        F.col("value").isNotNull()
    ).select("field", "value", RECORDS)


def latest_refresh(records: DataFrame, column: str = "lastRefresh") -> DataFrame:
    return records.agg(F.max(column).alias("latest_refresh"))
