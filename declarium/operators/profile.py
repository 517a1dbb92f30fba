"""Data quality: sizes, duplicates, missing values, and the findings table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from declarium.functions.dates import month_name
from declarium.operators.scale import broadcast_if_small, fixed
from declarium.operators.summaries import leading, record_cube
from declarium.schema import Columns


def row_digest(df: DataFrame) -> Column:
    """128 bits that stand for a whole row: 16 bytes to shuffle in place of the row.

    Two 64-bit hashes from different seeds. A hash skips NULLs, so the pattern of NULLs goes
    into it as well.
    """
    columns = [F.col(f"`{name}`") for name in df.columns]
    missing = F.array(*[column.isNull() for column in columns])
    return F.struct(
        F.xxhash64(*columns, missing).alias("a"), F.xxhash64(F.lit(1), *columns, missing).alias("b")
    )


def repeated_rows(df: DataFrame, digest: Column | None = None) -> DataFrame:
    """Fully equal rows beyond the first of each, in one row ``duplicate_rows``.

    Digests are counted first, 16 bytes a row; only rows whose digest stands there twice are then
    compared as a whole, so rows that merely share a digest are told apart.
    """
    names = [F.col(f"`{name}`") for name in df.columns]
    marked = df.withColumn("_digest", row_digest(df) if digest is None else digest)
    twice = marked.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_digest")
    equal = marked.join(broadcast_if_small(fixed(twice)), "_digest", "left_semi").groupBy(*names)
    beyond = equal.agg((F.count(F.lit(1)) - 1).alias("_n"))
    return beyond.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("duplicate_rows"))


def size_profile(df: DataFrame, digest: Column | None = None) -> DataFrame:
    """Rows, columns and fully equal rows beyond the first of each."""
    total = df.agg(F.count(F.lit(1)).alias("total_rows"))
    sizes = total.unionByName(repeated_rows(df, digest), allowMissingColumns=True)
    return sizes.agg(
        F.max("total_rows").alias("total_rows"),
        F.lit(len(df.columns)).alias("total_columns"),
        F.max("duplicate_rows").alias("duplicate_rows"),
    )


def table_profile(df: DataFrame, date: str, values: list[str]) -> DataFrame:
    """All of a table's profile but its equal rows, from one scan: rows (metric, name, n, at).

    ``rows`` holds the number of rows, ``missing`` the missing values of every column, ``earliest``
    and ``latest`` the date range, and ``year`` and each column of ``values`` its counts. Rows are
    counted by year and values together before the grouping sets copy that count. A table without
    rows has no profile.
    """
    year = F.year(date).cast("string")
    keys = {"_year": year} | {f"_{name}": F.col(f"`{name}`").cast("string") for name in values}
    missing = {name: f"_{i}_missing" for i, name in enumerate(df.columns)}
    sums = [F.count_if(F.col(f"`{name}`").isNull()).alias(alias) for name, alias in missing.items()]
    counted = df.groupBy(*[e.alias(name) for name, e in keys.items()]).agg(
        F.count(F.lit(1)).alias("_n"), F.min(date).alias("_first"), F.max(date).alias("_last"), *sums
    )
    sets = [[F.col(f"`{name}`")] for name in keys] + [[]]
    rolled = counted.groupingSets(sets, *[F.col(f"`{name}`") for name in keys]).agg(
        F.grouping_id().alias("_set"),
        F.sum("_n").alias("_n"), F.min("_first").alias("_first"), F.max("_last").alias("_last"),
        *[F.sum(alias).alias(alias) for alias in missing.values()],
    )
    whole = F.col("_set") == (1 << len(keys)) - 1

    def point(metric: str, name: Column, n: Column, at: Column | None = None) -> Column:
        at = (F.lit(None) if at is None else at).cast("timestamp_ntz")
        return F.struct(
            F.lit(metric).alias("metric"), name.cast("string").alias("name"),
            n.cast("long").alias("n"), at.alias("at"),
        )

    none = F.lit(None)
    of_table = [
        point("rows", none, F.col("_n")),
        point("earliest", none, none, F.col("_first")),
        point("latest", none, none, F.col("_last")),
        *[point("missing", F.lit(name), F.col(alias)) for name, alias in missing.items()],
    ]
    metrics = ["year", *values]
    of_keys = none
    for i, (metric, key) in enumerate(zip(metrics, keys)):
        own = F.col("_set") == (1 << len(keys)) - 1 - (1 << (len(keys) - 1 - i))
        of_keys = F.when(own, F.array(point(metric, F.col(f"`{key}`"), F.col("_n")))).otherwise(of_keys)
    return rolled.select(F.inline(F.when(whole, F.array(*of_table)).otherwise(of_keys))).where(
        F.col("name").isNotNull() | F.col("metric").isin("rows", "earliest", "latest")
    )


def duplicates_removed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before and after a cleaning step, and their difference."""
    sides = before.select(F.lit(1).alias("was"), F.lit(0).alias("is")).unionByName(
        after.select(F.lit(0).alias("was"), F.lit(1).alias("is"))
    )
    return sides.agg(
        F.coalesce(F.sum("was"), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("is"), F.lit(0)).alias("rows_after"),
        F.coalesce(F.sum(F.col("was") - F.col("is")), F.lit(0)).alias("duplicates_removed"),
    )


def missing_values(df: DataFrame, limit: int = 15) -> DataFrame:
    """Missing values per column, most first, from one pass over the table."""
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    listed = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("missing")) for c in df.columns]
    )
    return counts.select(F.inline(listed)).orderBy(F.col("missing").desc(), "column").limit(limit)


def health(records: DataFrame, source_label: str, is_sample: bool) -> DataFrame:
    return records.agg(
        F.lit("ok").alias("status"),
        F.lit(source_label).alias("data_source"),
        F.lit(is_sample).alias("sample_mode"),
        F.count(F.lit(1)).alias("declaration_records"),
    )


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of every table, as rows (metric, value)."""
    counts = [
        df.agg(F.lit(f"rows:{name}").alias("metric"), F.count(F.lit(1)).alias("value"))
        for name, df in tables.items()
    ]
    result = counts[0]
    for other in counts[1:]:
        result = result.unionByName(other)
    return result


def findings(records: DataFrame, columns: Columns = Columns()) -> DataFrame:
    """The leader of every breakdown and the size of the table: (metric, name, records).

    One scan: records are counted to cube grain, the cube to single keys, and the largest
    of each kind is kept. Equal counts: the smaller name.
    """
    when = F.col(columns.date)
    fields = {
        "total": F.lit("records"),
        "year": F.year(when).cast("string"),
        "month": month_name(when),
        "incident_type": F.col(columns.category),
        "state": F.col(columns.geo),
        "region": F.col(columns.group),
    }
    keyed = record_cube(records, columns).select(
        *[expression.alias(name) for name, expression in fields.items()], "records"
    )
    counts = keyed.groupingSets([[F.col(f)] for f in fields], *fields).agg(
        F.sum("records").alias("n")
    )
    values = counts.unpivot(["n"], list(fields), "metric", "name").where(
        F.col("name").isNotNull()
    )
    leader = leading(F.col("n"), F.col("name"))
    return values.groupBy("metric").agg(
        leader["key"].alias("name"), (-leader["minus"]).alias("records")
    )
