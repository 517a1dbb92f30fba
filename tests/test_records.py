"""Cleaning, filters and summaries on small hand-made frames."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from declarium.operators import filters, normalise, profile, sampling, star, summaries
from declarium.schema import NORMALISED_COLUMNS, RAW_COLUMNS, RAW_SCHEMA


def raw(spark, *changes):
    base = {name: None for name in RAW_COLUMNS} | {
        "id": "a", "disasterNumber": "7", "state": " tx", "declarationType": "dr",
        "declarationDate": "2020-03-04T00:00:00.000Z", "incidentType": "mud/landslide",
        "designatedArea": "ector (county)", "region": "6", "lastRefresh": "2021-01-01T00:00:00Z",
    }
    rows = [base | change for change in changes]
    return spark.createDataFrame([[r[n] for n in RAW_COLUMNS] for r in rows], RAW_SCHEMA)


def test_normalise_types_and_labels(spark):
    df = normalise.normalise(raw(spark, {}))
    assert df.columns == NORMALISED_COLUMNS
    row = df.first()
    assert (row.state, row.declarationTypeLabel, row.incidentType) == (
        "TX", "Major Disaster", "Mud/Landslide")
    assert (row.declarationDate, row.declarationMonthYear, row.femaRegion) == (
        datetime(2020, 3, 4), "2020-03", "Region 6")
    assert row.designatedArea == "Ector (County)" and row.declarationTitle == "Not Reported"
    assert row.declarationQuarter == 1 and row.designatedIncidentTypes is None


def test_normalise_keeps_nulls_and_undated_rows(spark):
    df = normalise.normalise(
        raw(spark, {"declarationDate": "bad", "state": " nan", "region": "4.5",
                    "declarationType": ""})
    )
    row = df.first()
    assert row.declarationDate is None and row.declarationMonthName is None
    assert row.state == "Not Reported" and row.femaRegion == "Not Reported"
    assert row.declarationType is None and row.declarationTypeLabel == "Not Reported"


def test_missing_columns_are_added(spark):
    df = spark.createDataFrame([("a", "dr")], "id string, declarationType string")
    row = normalise.normalise(df).first()
    assert row.disasterNumber is None and row.femaRegion == "Not Reported"
    assert row.declarationTypeLabel == "Major Disaster"


def test_latest_row_per_id_and_one_row_without_id(spark):
    df = raw(
        spark,
        {"disasterNumber": "1"},
        {"disasterNumber": "2", "lastRefresh": "2022-01-01T00:00:00Z"},
        {"id": None, "disasterNumber": "3"},
        {"id": None, "disasterNumber": "4", "lastRefresh": "2023-01-01T00:00:00Z"},
    )
    rows = normalise.normalise(df).collect()
    assert sorted((r.id or "", r.disasterNumber) for r in rows) == [("", 4), ("a", 2)]


def test_rows_without_any_id_are_compared_whole(spark):
    df = raw(spark, {"id": None}, {"id": None}, {"id": None, "state": "ca"})
    assert normalise.normalise(df).count() == 2


def test_clean_drops_equal_rows_only(spark):
    df = raw(spark, {}, {}, {"state": "TX"}, {"disasterNumber": "8"})
    cleaned = normalise.clean(df)
    assert cleaned.count() == 2 and len(cleaned.columns) == 34
    removed = profile.duplicates_removed(df, cleaned).first()
    assert tuple(removed) == (4, 2, 2)


def test_size_profile_counts_nulls_as_equal(spark):
    df = spark.createDataFrame(
        [(1, None), (1, None), (1, "x"), (None, None), (None, None), (None, None)],
        "a int, b string",
    )
    assert tuple(profile.size_profile(df).first()) == (6, 2, 3)


def test_missing_values(spark):
    df = spark.createDataFrame([(1, None, None), (None, None, "x")], "c int, a string, b string")
    assert [tuple(r) for r in profile.missing_values(df).collect()] == [
        ("a", 2), ("b", 1), ("c", 1)]
    assert profile.missing_values(df, 1).count() == 1


RECORDS = "id int, disasterNumber int, declarationDate timestamp_ntz, state string, " \
          "femaRegion string, incidentType string, declarationTypeLabel string"


def records(spark, rows):
    return spark.createDataFrame(rows, RECORDS)


def some_records(spark):
    return records(spark, [
        (1, 1, datetime(2020, 1, 31, 23, 59, 59, 999999), "TX", "Region 6", "Fire", "Emergency"),
        (2, 1, datetime(2020, 2, 1), "TX", "Region 6", "Flood", "Major Disaster"),
        (3, 2, datetime(2019, 5, 5), "AL", "Region 10", "Flood", "Major Disaster"),
        (4, None, datetime(2019, 5, 6), "AL", "Not Reported", "Fire", "Major Disaster"),
        (5, 3, None, "AL", "Region 10", None, "Emergency"),
        (6, 3, datetime(2021, 5, 6), None, "Region 2", "Fire", None),
    ])


def ids(df):
    return sorted(row.id for row in df.collect())


def test_filter_end_day_is_inclusive_and_undated_rows_never_pass(spark):
    df = some_records(spark)
    assert ids(filters.apply_filters(df, end="2020-01-31")) == [1, 3, 4]
    assert ids(filters.apply_filters(df, start="2020-02-01")) == [2, 6]
    assert ids(filters.apply_filters(df)) == [1, 2, 3, 4, 6]
    assert ids(filters.apply_filters(df, type_labels=["Emergency"])) == [1]
    assert ids(filters.apply_filters(df, geos=["TX"], categories=["Flood"])) == [2]
    assert ids(filters.apply_filters(df, groups=["Region 10", "Region 2"])) == [3, 6]
    with pytest.raises(ValueError):
        filters.apply_filters(df, start="2020-02-02", end="2020-02-01")


def test_date_range(spark):
    df = some_records(spark)
    assert tuple(filters.date_range(df).first()) == (date(2019, 5, 5), date(2021, 5, 6), 5)
    assert filters.date_range(df.where("declarationDate IS NULL")).isEmpty()


def test_year_bounds_stay_ordered():
    assert filters.year_bounds(2001, 1999) == (date(2001, 1, 1), date(2001, 12, 31))


def test_summary(spark):
    row = summaries.summary(some_records(spark)).first()
    # Fire 3, Flood 2; AL 3; 2019 and 2020 tie and the earlier year wins.
    assert tuple(row) == (6, 3, "AL", "Fire", 2019)
    assert summaries.summary(some_records(spark).limit(0)).isEmpty()


def test_rankings_break_ties_by_name_and_skip_missing_keys(spark):
    df = some_records(spark)
    assert [tuple(r) for r in summaries.top_values(df, "state").collect()] == [("AL", 3), ("TX", 2)]
    labels = [tuple(r) for r in summaries.top_values(df, "declarationTypeLabel").collect()]
    assert labels == [("Major Disaster", 3), ("Emergency", 2)]
    pairs = [tuple(r) for r in summaries.top_pairs(df, 2).collect()]
    assert pairs == [("AL", "Fire", 1), ("AL", "Flood", 1)]
    for limit in (0, 51):
        with pytest.raises(ValueError):
            summaries.top_values(df, "state", limit)


def test_not_reported_is_removed_after_the_cut(spark):
    df = spark.createDataFrame([("Not Reported",)] * 3 + [("b",)] * 2 + [("a",)], "g string")
    assert [r.name for r in summaries.top_reported(df, "g", 2).collect()] == ["b"]


def test_region_counts_in_region_order(spark):
    points = [tuple(r) for r in summaries.region_counts(some_records(spark)).collect()]
    assert points == [("Region 2", 1), ("Region 6", 2), ("Region 10", 2)]


def test_trends(spark):
    df = some_records(spark)
    assert [tuple(r) for r in summaries.trend(df).collect()] == [
        ("2019", 2), ("2020", 2), ("2021", 1)]
    assert [r.period for r in summaries.trend(df, "month").collect()] == [
        "2019-05", "2020-01", "2020-02", "2021-05"]
    with pytest.raises(ValueError):
        summaries.trend(df, "week")


def test_seasonality_has_twelve_months(spark):
    points = summaries.seasonality(some_records(spark)).collect()
    assert [p.declaration_records for p in points] == [1, 1, 0, 0, 3] + [0] * 7
    assert points[11].name == "December"
    assert len(summaries.seasonality(some_records(spark).limit(0)).collect()) == 12


def test_metadata(spark):
    rows = [tuple(r) for r in summaries.metadata(some_records(spark)).collect()]
    values = lambda field: [v for f, v in rows if f == field]
    assert values("regions") == ["Region 2", "Region 6", "Region 10"]
    assert values("years") == ["2019", "2020", "2021"] and values("states") == ["AL", "TX"]
    assert values("minimum_date") == ["2019-05-05"] and values("maximum_date") == ["2021-05-06"]


def test_cube_gives_the_same_figures_as_the_records(spark):
    df = some_records(spark)
    cube = summaries.record_cube(df)
    same = lambda a, b: [tuple(r) for r in a.collect()] == [tuple(r) for r in b.collect()]
    assert same(summaries.trend(df), summaries.trend(cube, weight="records"))
    assert same(summaries.seasonality(df), summaries.seasonality(cube, weight="records"))
    assert same(summaries.top_values(df, "state"),
                summaries.top_values(cube, "state", weight="records"))
    assert same(summaries.region_counts(df), summaries.region_counts(cube, weight="records"))


def test_breakdowns_sum_to_the_records_with_that_key(spark):
    df = some_records(spark)
    totals = {r.field: r.n for r in summaries.breakdowns(df).groupBy("field").agg(
        F.sum("declaration_records").alias("n")).collect()}
    assert totals == {"year": 5, "month": 5, "geo": 5, "group": 6, "category": 5, "type_label": 5}


def test_findings(spark):
    found = {r.metric: (r.name, r.records) for r in profile.findings(some_records(spark)).collect()}
    assert found == {"total": ("records", 6), "year": ("2019", 2), "month": ("May", 3),
                     "incident_type": ("Fire", 3), "state": ("AL", 3), "region": ("Region 10", 2)}


def test_health_and_refresh(spark):
    df = some_records(spark)
    assert tuple(profile.health(df, "here", True).first()) == ("ok", "here", True, 6)
    assert summaries.latest_refresh(df, "declarationDate").first()[0] == datetime(2021, 5, 6)


@pytest.mark.parametrize("limit", [0, 1000])
def test_null_keys_find_their_dimension_row(spark, monkeypatch, limit):
    monkeypatch.setattr(star, "broadcast_if_small",
                        lambda df: F.broadcast(df) if df.limit(limit + 1).count() <= limit else df)
    rows = [("Fire", None, 1), ("Fire", "R", 2), (None, None, 3), ("Fire", None, 4),
            ("Flood", "R", 5)]
    df = spark.createDataFrame(
        rows, "incidentType string, designatedIncidentTypes string, id int"
    ).withColumn("declarationDate", F.lit(None).cast("timestamp_ntz")).withColumn(
        "state", F.lit(None).cast("string"))
    kinds, locations = star.dim_incident_type(df), star.dim_location(df)
    assert sorted(r.incidentTypeKey for r in kinds.collect()) == [1, 2, 3, 4]
    assert [tuple(r) for r in locations.collect()] == [(1, None)]
    facts = {r.id: r for r in star.fact(df, locations, kinds).collect()}
    assert len(facts) == 5 and {f.locationKey for f in facts.values()} == {1}
    assert facts[1].incidentTypeKey == facts[4].incidentTypeKey
    assert len({f.incidentTypeKey for f in facts.values()}) == 4
    assert {f.dateKey for f in facts.values()} == {None}
    joined = star.denormalise(star.fact(df, locations, kinds), star.dim_date(df), locations, kinds)
    assert joined.count() == 5


def test_date_dimension_has_one_row_per_day(spark):
    df = spark.createDataFrame(
        [(datetime(2020, 1, 1, 5),), (datetime(2020, 1, 1, 9),), (None,)],
        "declarationDate timestamp_ntz")
    assert [r.dateKey for r in star.dim_date(df).collect()] == [20200101]
    with pytest.raises(ValueError):
        star.dim_date(df.drop("declarationDate"))


@pytest.mark.parametrize("rows,n", [(10, 10), (10, 3), (1001, 1000), (2500, 1000), (997, 100)])
def test_systematic_sample_positions(spark, rows, n):
    df = spark.range(rows).select("id", F.lit(None).cast("timestamp_ntz").alias("d"))
    expected = sorted(int(i * (rows / n)) for i in range(n))
    exact = sorted(i * rows // n for i in range(n))
    found = sorted(r.id for r in sampling.systematic(df, "id", "d", n).collect())
    assert found == exact
    assert sum(a != b for a, b in zip(exact, expected)) == 0


def test_head_per_group(spark):
    df = spark.range(20).withColumn("g", F.col("id") % 3)
    kept = sampling.head_per_group(df, "g", [F.col("id")], 2)
    assert ids(kept) == [0, 1, 2, 3, 4, 5]


def test_listing_keeps_existing_columns_in_order(spark):
    assert filters.listing(some_records(spark)).columns == [
        "disasterNumber", "declarationDate", "state", "femaRegion", "incidentType",
        "declarationTypeLabel"]
    newest = filters.newest_first(some_records(spark)).collect()
    assert [r.id for r in newest] == [6, 2, 1, 4, 3, 5]
