"""What the plans must look like to hold on large and skewed tables."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from declarium.operators import filters, normalise, series, summaries
from declarium.operators.scale import broadcast_if_small, dense_positions
from declarium.plans.registry import QUERIES
from declarium.plans.tables import COLUMNS, records, table

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_python_in_any_query(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for operator in ["CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas",
                     "MapInArrow"]:
        assert operator not in text


def test_filters_and_columns_reach_the_scan(spark):
    df = filters.apply_filters(records(spark, SF, False), COLUMNS, "1996-01-01", "1997-12-31",
                               categories=["2-HIGH"])
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    text = plan(summaries.trend(df, "year", COLUMNS))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(o_orderdate,1996-01-01T00:00)" in text
    assert "LessThan(o_orderdate,1998-01-01T00:00)" in text
    assert "EqualTo(o_orderpriority,2-HIGH)" in text
    assert re.search(r"ReadSchema: struct<o_orderdate:timestamp_ntz,o_orderpriority:string>", text)


def test_duplicates_of_an_id_are_cut_before_the_shuffle(spark):
    text = plan(QUERIES["dedupe_latest"](spark, SF))
    assert text.count("WindowGroupLimit") == 2
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_counts_are_combined_before_the_shuffle(spark):
    text = plan(series.forecast_cube(records(spark, SF), "2001-08-15", COLUMNS))
    assert text.index("[count(1)]") < text.index("Exchange hash") < text.index("[partial_count(1)]")


def test_breakdowns_expand_the_cube_not_the_records(spark):
    text = plan(summaries.breakdowns(records(spark, SF), COLUMNS))
    assert text.count("FileScan parquet [o_") == 1
    assert text.index("Expand") < text.index("partial_count(1)")


def test_key_figures_need_one_scan(spark):
    for name in ["summary_kpis", "metadata_values", "findings", "insight_spikes"]:
        assert plan(QUERIES[name](spark, SF)).count("FileScan parquet [o_") == 1, name


def test_lookup_is_broadcast_only_up_to_its_limit(spark):
    small = spark.range(10)
    assert "BroadcastHashJoin" in plan(spark.range(10**6).join(broadcast_if_small(small, 10), "id"))
    assert broadcast_if_small(small, 9) is small


def test_a_lookup_beyond_the_limit_is_joined_by_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.range(1000).join(broadcast_if_small(spark.range(100), 10), "id")
        assert "SortMergeJoin" in plan(joined) and joined.count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_positions_are_dense_whatever_the_partitions(spark):
    df = spark.range(5000, numPartitions=13).select((F.col("id") * 7919 % 5003).alias("k"))
    placed = [tuple(r) for r in dense_positions(df, [F.col("k")], "p").orderBy("k").collect()]
    assert [p for _, p in placed] == list(range(5000))


def test_a_third_of_the_rows_under_one_key(spark):
    """One id, one place and one day hold a third of the rows; figures stay whole."""
    hot = F.col("id") % 3 == 0
    df = spark.range(60000).select(
        F.when(hot, -1).otherwise(F.col("id")).alias("id"),
        F.when(hot, -1).otherwise(F.col("id") % 100).alias("disasterNumber"),
        F.when(hot, F.lit(datetime(2020, 1, 1))).otherwise(
            F.timestamp_add("DAY", (F.col("id") % 3000).cast("int"), F.lit(datetime(2010, 1, 1)))
        ).cast("timestamp_ntz").alias("declarationDate"),
        F.when(hot, "TX").otherwise(F.concat(F.lit("S"), F.col("id") % 50)).alias("state"),
        F.lit("Fire").alias("incidentType"),
        F.when(hot, "Region 6").otherwise("Region 1").alias("femaRegion"),
        F.col("id").alias("version"),
    )
    kept = normalise.latest_per_id(df, "id", [F.col("version")])
    assert kept.count() == 40001
    assert kept.where("id = -1").first().version == 59997
    assert tuple(summaries.summary(df).first()) == (60000, 101, "TX", "Fire", 2020)
    counts = series.monthly_counts(df, "2021-01-01").agg(F.sum("n")).first()[0]
    assert counts == 60000


def test_order_tables_have_the_declared_columns(spark):
    from declarium.plans.tables import SCHEMAS

    for name in SCHEMAS:
        found = spark.read.parquet(f"{SF}/{name}.parquet").schema
        assert [(f.name, f.dataType) for f in found] == [
            (f.name, f.dataType) for f in table(spark, SF, name).schema], name
