"""Exact duplicates, the profile from one scan, key figures and replaced tables."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from declarium.operators import normalise, profile, summaries
from declarium.plans import pipeline
from declarium.plans.tables import COLUMNS, raw_records, records
from declarium.sources import readers, writers

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_that_share_a_digest_are_no_duplicates(spark):
    df = spark.createDataFrame(
        [(1, "a"), (1, "a"), (1, "a"), (2, None), (2, None), (None, "2"), (3, "b"), (None, None)],
        "n int, t string",
    )
    assert profile.size_profile(df).first().asDict() == {
        "total_rows": 8, "total_columns": 2, "duplicate_rows": 3,
    }
    for forced in (F.lit(1), F.coalesce(F.col("n") % 2, F.lit(7)), F.col("t").isNull()):
        assert profile.size_profile(df, forced).first().duplicate_rows == 3
    assert profile.size_profile(df.limit(0)).first().duplicate_rows == 0
    assert profile.size_profile(df.where("n = 3")).first().duplicate_rows == 0


def test_a_third_of_the_rows_are_one_row(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("v"))
    assert profile.size_profile(df).first().duplicate_rows == 9_999


def test_profile_from_one_scan(spark):
    typed = normalise.typed(raw_records(spark, SF))
    found = profile.table_profile(typed, "declarationDate", ["incidentType", "state"])
    assert plan(found).count("FileScan parquet [o_") == 1
    rows = {(r.metric, r.name): r.n for r in found.collect()}
    missing = {r.column: r.missing for r in profile.missing_values(typed, 99).collect()}
    assert {name: n for (metric, name), n in rows.items() if metric == "missing"} == missing
    for column in ("incidentType", "state"):
        counts = {r[column]: r.n for r in summaries.count_by(typed, {column: F.col(column)}, name="n").collect()}
        assert {name: n for (metric, name), n in rows.items() if metric == column} == counts
    assert rows["rows", None] == 1500


def test_profile_of_nothing(spark):
    empty = normalise.typed(raw_records(spark, SF)).limit(0)
    assert profile.table_profile(empty, "declarationDate", ["state"]).isEmpty()


def test_key_figures_copy_a_count_without_the_entity(spark):
    text = plan(summaries.summary(records(spark, SF), COLUMNS))
    copies = re.findall(r"Expand (.*)", text)
    # the upper copy stands over a count of place, category and year; the lower one turns a record
    # into its combination here and its entity there
    holds_entity = [bool(re.search(r"(?<!of_)entity#", copy)) for copy in copies]
    assert holds_entity == [False, True]
    assert text.count("FileScan parquet [o_") == 1


@pytest.mark.parametrize("weighted", [False, True])
def test_key_figures_with_missing_keys(spark, weighted):
    rows = [
        ("TX", "Fire", datetime(2020, 1, 1), 1), ("TX", None, datetime(2020, 1, 2), 1),
        (None, "Fire", datetime(2021, 1, 1), None), (None, None, None, 2), (None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "state string, incidentType string, declarationDate timestamp, disasterNumber int")
    weight = "w" if weighted else None
    df = df.withColumn("w", F.lit(3).cast("long"))
    assert tuple(summaries.summary(df, weight=weight).first()) == (15 if weighted else 5, 2, "TX", "Fire", 2020)
    bare = df.withColumn("disasterNumber", F.lit(None).cast("int"))
    assert summaries.summary(bare).first().unique_disaster_numbers == 0
    assert summaries.summary(df.limit(0)).isEmpty()


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "table")
    writers.write_table(spark.range(5), path)
    broken = spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("no"))).otherwise("x").alias("v"))
    with pytest.raises(Exception, match="no"):
        writers.write_table(broken, path)
    assert spark.read.parquet(path).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["table"]
    writers.write_table(spark.range(7), path)
    assert spark.read.parquet(path).count() == 7
    # a table can be replaced by what is read from itself
    writers.write_table(spark.read.parquet(path).where("id < 3"), path)
    assert spark.read.parquet(path).count() == 3
    assert not [p.name for p in tmp_path.iterdir() if ".old-" in p.name]
    writers.write_csv(spark.range(2), str(tmp_path / "csv"))
    writers.write_csv(spark.range(3), str(tmp_path / "csv"))
    assert readers.read_csv(spark, str(tmp_path / "csv")).count() == 3


def test_what_cannot_be_published_is_put_back(spark, tmp_path):
    path = str(tmp_path / "table")
    writers.write_table(spark.range(5), path)
    with pytest.raises(OSError):
        writers.publish(spark, str(tmp_path / "missing"), path)
    assert spark.read.parquet(path).count() == 5


def test_files_keep_the_order(spark, tmp_path):
    """A third of the rows have one date; files follow each other, and each is sorted."""
    df = spark.range(5000).select(
        F.col("id").cast("string").alias("id"),
        F.when(F.col("id") % 3 == 0, F.lit("2020-05-05"))
        .when(F.col("id") % 41 != 1, F.concat(F.lit("20"), F.lpad(F.col("id") % 30, 2, "0"), F.lit("-01-01")))
        .cast("timestamp_ntz").alias("declarationDate"),
    )
    path = writers.write_newest_first(df.repartition(9), str(tmp_path / "t"))
    placed = writers.in_file_order(spark, path)
    assert "Sort" not in plan(placed.select("id", "position")).split("BroadcastExchange")[0]
    found = [(r.declarationDate, r.id) for r in sorted(placed.collect(), key=lambda r: r.position)]
    assert [r.position for r in placed.orderBy("position").collect()] == list(range(5000))
    expected = sorted(((r.declarationDate, r.id) for r in df.collect()), key=lambda r: r[1])
    expected.sort(key=lambda r: (r[0] is not None, r[0] or datetime.min), reverse=True)
    assert found == expected


def test_stages_read_the_landed_table(spark, tmp_path, monkeypatch):
    """The pipeline reads the raw file once, whatever its stages ask for."""
    raw = tmp_path / "raw.csv"
    raw_records(spark, SF).toPandas().to_csv(raw, index=False)
    reads = []
    read = readers.read_raw
    monkeypatch.setattr(pipeline.readers, "read_raw", lambda *a: reads.append(a) or read(*a))
    folder = str(tmp_path / "out")
    landed = pipeline.land_stage(spark, str(raw), folder)
    assert "FileScan csv" not in plan(landed) and len(reads) == 1
    tables = pipeline.profile_stage(landed, folder)
    for df in tables.values():
        assert "FileScan csv" not in plan(df)
    assert landed.count() == 1500 and len(reads) == 1
