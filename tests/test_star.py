"""The star from one count, against counting by hand; its scans and jobs."""

import uuid

from pyspark.sql import functions as F

from declarium.operators import scale, star
from declarium.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "state string, designatedArea string, incidentType string, designatedIncidentTypes string, declarationDate timestamp_ntz, id string"


def rows(spark):
    from datetime import datetime

    places = [("TX", "A"), ("TX", None), (None, "A"), ("AL", "B"), (None, None)]
    kinds = [("Fire", None), ("Flood", "W"), (None, "W")]
    data = []
    for i in range(300):
        when = None if i % 10 == 0 else datetime(2020, 1, 1 + i % 7, i % 24)
        data.append((*places[0 if i % 3 == 0 else i % 5], *kinds[i % 3], when, str(i)))
    return data, spark.createDataFrame(data, SCHEMA)


def numbered(values):
    """1, 2, … in order, missing values first."""
    key = lambda row: [(v is not None, v or "") for v in row]
    return {row: i + 1 for i, row in enumerate(sorted(set(values), key=key))}


def test_dimensions_and_facts(spark):
    data, df = rows(spark)
    built = star.build(df)
    places = numbered((r[0], r[1]) for r in data)
    kinds = numbered((r[2], r[3]) for r in data)
    assert {tuple(r)[1:]: r.locationKey for r in built.locations.collect()} == places
    assert {tuple(r)[1:]: r.incidentTypeKey for r in built.incident_types.collect()} == kinds
    days = {r[4].date() for r in data if r[4]}
    found = built.dates.collect()
    assert {r.fullDate for r in found} == days and len(found) == len(days)
    # the same as building each dimension from the records
    for a, b in [(built.locations, star.dim_location(df)), (built.incident_types, star.dim_incident_type(df)),
                 (built.dates, star.dim_date(df))]:
        assert a.columns == b.columns and set(a.collect()) == set(b.collect())

    facts = star.fact(df, built.locations, built.incident_types, ["id", "dateKey", "locationKey", "incidentTypeKey"])
    expected = {
        (r[5], int(r[4].strftime("%Y%m%d")) if r[4] else None, places[r[:2]], kinds[r[2:4]]) for r in data
    }
    assert set(map(tuple, facts.collect())) == expected and facts.count() == 300
    counted = star.counted_facts(built)
    sums = counted.agg(F.sum("n").alias("n"), F.count("*").alias("rows")).first()
    assert sums.n == 300 and sums.rows == len({r[1:] for r in expected})
    joined = star.denormalise(counted, built.dates, built.locations, built.incident_types)
    assert joined.agg(F.sum("n")).first()[0] == 300
    assert joined.where("year IS NULL").agg(F.sum("n")).first()[0] == 30


def jobs_of(spark, run):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        result = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return result, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_the_sources_are_read_once_and_in_few_jobs(spark, monkeypatch):
    """Dimensions and the counted star come from the one count that is kept."""
    kept = []
    monkeypatch.setattr(
        star, "fixed", lambda df: kept.append(df._jdf.queryExecution().toString()) or scale.fixed(df)
    )
    summary, jobs = jobs_of(spark, lambda: QUERIES["star_summary"](spark, SF))
    plan = summary._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan
    scans = [text.split("== Physical Plan ==")[1].count("FileScan parquet [o_") for text in kept]
    assert scans == [1, 0]
    # three of them send customers, nations and regions to the tasks
    assert jobs <= 10, jobs


def test_dimensions_too_large_for_a_task(spark, monkeypatch):
    _, df = rows(spark)
    usual = star.build(df)
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 2)
    large = star.build(df)
    for a, b in zip((usual.dates, usual.locations, usual.incident_types),
                    (large.dates, large.locations, large.incident_types)):
        assert set(a.collect()) == set(b.collect())
    assert set(star.counted_facts(usual).collect()) == set(star.counted_facts(large).collect())


def test_a_lookup_is_sent_by_its_bytes_as_well(spark, monkeypatch):
    wide = spark.range(100).withColumn("text", F.repeat(F.lit("x"), 1000))
    assert scale.broadcast_if_small(wide) is not wide
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 50_000)
    assert scale.broadcast_if_small(wide) is wide
    assert scale.broadcast_if_small(wide.select("id")).columns == ["id"]
    nested = spark.range(3).select(
        F.array(F.lit("a"), F.lit("b")).alias("a"), F.struct("id").alias("s"), F.lit(b"xyz").alias("b"),
        F.lit(None).cast("string").alias("n"),
    )
    assert nested.agg(F.min(scale.row_bytes(nested))).first()[0] > 32
