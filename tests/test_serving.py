from datetime import date

import pytest
from pyspark.sql import functions as F

from declarium.operators import serving
from declarium.schema import FORECAST_TYPE_COLUMNS

AS_OF = "2020-06-15"
SCHEMA = ("region string, month date, recordType string, declarationRecords bigint, "
          "likelyIncidentType string, likelyAreas string")


def months(start, count):
    index = start.year * 12 + start.month - 1
    return [date((index + k) // 12, (index + k) % 12 + 1, 1) for k in range(count)]


def stored(spark):
    """Region 1 is usable; the others are stale, short, or lack a category."""
    rows = []
    for region, first, count in [("Region 1", date(2020, 7, 1), 8), ("Region 2", date(2020, 8, 1), 8),
                                 ("Region 3", date(2020, 7, 1), 5), ("Region 4", date(2020, 7, 1), 8),
                                 ("Region 5", date(2020, 6, 1), 9)]:
        rows += [(region, m, "Historical", 1, None, None) for m in months(date(2018, 1, 1), 30)]
        rows += [(region, m, "Forecast", i, "Fire", "TX") for i, m in enumerate(months(first, count))]
    rows[3 * 30 + 8 + 8 + 5 + 30 + 2] = ("Region 4", date(2020, 9, 1), "Forecast", 2, None, "TX")
    df = spark.createDataFrame(rows, SCHEMA)
    extra = set(FORECAST_TYPE_COLUMNS) - set(df.columns)
    return df.withColumns({name: F.lit("-") for name in extra})


def test_only_usable_regions_are_served(spark):
    shown = serving.serving_slice(stored(spark), AS_OF, 6, 24).collect()
    # Region 5 has an older forecast month before the floor, which is left out.
    assert {r.region for r in shown} == {"Region 1", "Region 5"}
    mine = [r for r in shown if r.region == "Region 1"]
    past = sorted(r.month for r in mine if r.recordType == "Historical")
    ahead = sorted(r.month for r in mine if r.recordType == "Forecast")
    assert past == months(date(2018, 7, 1), 24)
    assert ahead == months(date(2020, 7, 1), 6)


def test_a_null_beyond_the_horizon_does_not_matter(spark):
    shown = serving.serving_slice(stored(spark), AS_OF, 2, 24)
    assert {r.region for r in shown.select("region").distinct().collect()} == {
        "Region 1", "Region 3", "Region 4", "Region 5"}


def test_stored_table_without_category_columns_is_not_served(spark):
    assert serving.serving_slice(stored(spark).drop("likelyAreas"), AS_OF).isEmpty()


def test_other_regions_are_recomputed(spark):
    fresh = stored(spark).withColumn("declarationRecords", F.lit(99).cast("bigint"))
    served = serving.serve(stored(spark), fresh, AS_OF, 6, 24)
    marks = {r.region: r.marks for r in served.groupBy("region").agg(
        F.max(F.col("declarationRecords") == 99).alias("marks")).collect()}
    assert marks == {"Region 1": False, "Region 5": False, "Region 2": True, "Region 3": True,
                     "Region 4": True}


def test_names_survive_the_way_out_and_back(spark):
    points = serving.served_points(stored(spark))
    assert {"record_type", "likely_incident_type", "type_method"} <= set(points.columns)
    assert points.first().month == "2018-01"
    back = serving.from_served(points)
    assert back.columns == stored(spark).columns and back.first().month == date(2018, 1, 1)


def test_comparison(spark):
    rows = [
        ("Region 1", date(2020, 7, 1), "Forecast", 5, "Flood", "AL"),
        ("Region 1", date(2020, 8, 1), "Forecast", 9, "Fire", "TX"),
        ("Region 1", date(2020, 9, 1), "Forecast", 9, "Flood", "LA"),
        ("Region 1", date(2020, 5, 1), "Forecast", 900, "Snow", "AK"),
        ("Region 1", date(2020, 5, 1), "Historical", 900, None, None),
        ("Region 2", date(2020, 7, 1), "Forecast", 0, None, None),
    ]
    found = {r.region: tuple(r)[1:] for r in serving.comparison(
        spark.createDataFrame(rows, SCHEMA), AS_OF).collect()}
    assert found["Region 1"] == (23, pytest.approx(23 / 3), date(2020, 8, 1), 9, "Flood", "AL")
    assert found["Region 2"] == (0, 0.0, date(2020, 7, 1), 0, "N/A", "Region-wide")


def test_comparison_starts_with_the_preferred_regions(spark):
    df = spark.createDataFrame([(f"Region {i}",) for i in (10, 9, 2, 1, 4)], "region string")
    assert [r.region for r in serving.comparison_regions(df).collect()] == [
        "Region 4", "Region 9", "Region 1"]


def test_served_rows_keep_columns_that_the_stored_table_lacks(spark):
    from declarium.operators.serving import serve

    stored = spark.createDataFrame(
        [("Region 1", None, "Forecast")], "region string, month date, recordType string"
    ).limit(0)
    columns = "region string, month date, recordType string, likelyIncidentType string"
    computed = spark.createDataFrame([("Region 2", None, "Forecast", "Fire")], columns)
    served = serve(stored, computed, "2024-05-01")
    assert served.columns == computed.columns
    assert [r.likelyIncidentType for r in served.collect()] == ["Fire"]


def test_arguments_are_checked_before_any_job(spark):
    import pytest

    from declarium.operators.filters import date_range
    from declarium.operators.forecast import region_forecast

    records = spark.range(1)
    with pytest.raises(ValueError):
        region_forecast(records, as_of="2024-05-01", horizon=99)
    with pytest.raises(ValueError):
        date_range(records, start="2024-05-02", end="2024-05-01")


def test_only_regions_without_a_usable_forecast_are_forecast(spark, monkeypatch):
    """Usable regions leave the records before anything is counted."""
    from datetime import datetime

    from declarium.operators import forecast

    rows = [
        (f"Region {region}", datetime(2010 + i // 12, i % 12 + 1, 3), "Fire" if i % 2 else "Flood", "TX")
        for region in range(1, 7) for i in range(120) for _ in range(1 + i % 3)
    ]
    records = spark.createDataFrame(
        rows, "femaRegion string, declarationDate timestamp_ntz, incidentType string, state string"
    )
    seen = []
    cube = forecast.forecast_cube

    def counted(df, *rest):
        seen.append({r[0] for r in df.select("femaRegion").distinct().collect()})
        return cube(df, *rest)

    monkeypatch.setattr(forecast, "forecast_cube", counted)
    served = serving.serve_or_forecast(stored(spark), records, AS_OF, 6, 24).collect()
    # regions 1 and 5 are usable; the sixth has no stored forecast at all
    assert seen == [{f"Region {i}" for i in (2, 3, 4, 6)}]
    assert {r.region for r in served} == {f"Region {i}" for i in range(1, 7)}
    fresh = {
        tuple(r) for r in forecast.region_forecast(records, AS_OF, 6, 24).collect()
        if r.region not in ("Region 1", "Region 5")
    }
    assert {tuple(r) for r in served if r.region not in ("Region 1", "Region 5")} == fresh
    kept = serving.serving_slice(stored(spark), AS_OF, 6, 24).collect()
    mine = [r for r in served if r.region in ("Region 1", "Region 5")]
    assert {(r.region, r.month, r.declarationRecords) for r in mine} == {
        (r.region, r.month, r.declarationRecords) for r in kept}
    assert {r.method for r in mine} == {None}


def test_all_regions_usable_or_none(spark):
    usable = stored(spark).where("region IN ('Region 1', 'Region 5')")
    empty = spark.createDataFrame(
        [], "femaRegion string, declarationDate timestamp_ntz, incidentType string, state string"
    )
    served = serving.serve_or_forecast(usable, empty, AS_OF, 6, 24)
    assert {r.region for r in served.collect()} == {"Region 1", "Region 5"}
    assert serving.serve_or_forecast(usable.limit(0), empty, AS_OF, 6, 24).isEmpty()
