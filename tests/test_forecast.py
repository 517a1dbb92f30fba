from collections import Counter
from datetime import date, datetime

import by_hand
import numpy as np
import pytest
from pyspark.sql import functions as F

from declarium.operators import categories, forecast, models, series
from declarium.schema import FORECAST_COLUMNS

AS_OF = "2020-06-15"
FLOOR = date(2020, 6, 1)
SCHEMA = "declarationDate timestamp_ntz, femaRegion string, incidentType string, state string"


def made(region, months, seed, level=6.0, names=("Fire", "flood ", "Mud/Slide"), last=1):
    """Records of one region: ``months`` months up to ``last`` months before the floor."""
    rng = np.random.default_rng(seed)
    rows = []
    for back in range(months + last - 1, last - 1, -1):
        month = by_hand.shift(FLOOR, -back)
        count = rng.poisson(level * (1 + 0.6 * np.sin(month.month)))
        if back in (last, months + last - 1):
            count = max(count, 1)
        for _ in range(count):
            name = names[int(rng.integers(len(names)))]
            place = ["TX", " al", "Not Reported", None, "la"][int(rng.integers(5))]
            rows.append((datetime(month.year, month.month, int(rng.integers(1, 28))),
                         region, name, place))
    return rows


def expected(rows, horizon):
    counts = Counter(date(r[0].year, r[0].month, 1) for r in rows if r[0].date() < FLOOR)
    first, last = min(counts), max(counts)
    months = [by_hand.shift(first, k) for k in range(by_hand.gap(last, first) + 1)]
    volume = by_hand.volume(months, [counts[m] for m in months], date(2020, 7, 1), horizon)
    seen = set()
    for when, _, name, place in rows:
        month = date(when.year, when.month, 1)
        name = name.strip().title() if name else ""
        if name in ("", "Not Reported") or not by_hand.shift(FLOOR, -180) <= month < FLOOR:
            continue
        place = (place or "").strip().upper()
        place = "Region-wide" if place in ("", "NOT REPORTED") else place
        seen.add((month, name, place, 0.5 ** (by_hand.gap(FLOOR, month) / 60)))
    return months, counts, volume, seen


CASES = {
    "Region 1": dict(months=100, seed=1),
    "Region 2": dict(months=47, seed=2),
    "Region 3": dict(months=48, seed=3),
    "Region 4": dict(months=20, seed=4),
    "Region 5": dict(months=240, seed=5, level=1.0),
    "Region 6": dict(months=60, seed=6, last=9),
    "Region 7": dict(months=30, seed=7, names=("Not Reported", " ", None)),
    "Region 8": dict(months=3, seed=8),
    "Region 9": dict(months=200, seed=9, level=30.0, names=("Fire", "Fire", "Flood")),
    "Region 10": dict(months=1, seed=10),
}


@pytest.fixture(scope="module")
def rows():
    # One region holds far more records than any other.
    made_rows = [r for name, case in CASES.items() for r in made(name, **case)]
    return made_rows + made("Region 1", 100, 11, level=200.0)


@pytest.fixture(scope="module")
def result(spark, rows):
    extra = [(datetime(2020, 6, 2), "Region 1", "Fire", "TX"),
             (datetime(2020, 1, 2), "Not Reported", "Fire", "TX"),
             (None, "Region 1", "Fire", "TX"), (datetime(2020, 1, 2), None, "Fire", "TX"),
             (datetime(2020, 6, 2), "Region 99", "Fire", "TX")]
    df = spark.createDataFrame(rows + extra, SCHEMA)
    built = forecast.region_forecast(df, AS_OF, 18, 24, generated_at="now")
    assert built.columns == FORECAST_COLUMNS
    return forecast.in_region_order(built).collect()


@pytest.mark.parametrize("region", CASES)
def test_region_equals_the_forecast_by_hand(rows, result, region):
    mine = [r for r in result if r.region == region]
    months, counts, (model, error, numbers), seen = expected(
        [r for r in rows if r[1] == region], 18)
    past = [r for r in mine if r.recordType == "Historical"]
    assert [(r.month, r.declarationRecords) for r in past] == [
        (m, counts[m]) for m in months[-24:]]
    ahead = [r for r in mine if r.recordType == "Forecast"]
    assert [r.month for r in ahead] == [by_hand.shift(date(2020, 7, 1), k) for k in range(18)]
    assert [(r.declarationRecords, r.lowerEstimate, r.upperEstimate) for r in ahead] == numbers
    assert model in mine[0].method.replace("-trend", "")
    (reported,) = {r.validationMae for r in mine}
    assert reported == (pytest.approx(error, rel=1e-9) if error is not None else None)
    for r in ahead:
        found = (r.likelyIncidentType, r.incidentTypeSupport, r.incidentTypeConfidence,
                 r.likelyAreas)
        wanted = by_hand.category(sorted(seen), r.month.month)
        assert found == (wanted[0], pytest.approx(wanted[1], abs=0.1001), *wanted[2:])
    assert {r.trainingThrough for r in mine} == {months[-1].isoformat()[:7]}
    assert {(r.forecastStart, r.asOfDate, r.generatedAt) for r in mine} == {
        ("2020-07", "2020-06-15", "now")}


@pytest.mark.parametrize("region", CASES)
def test_scores_before_rounding(spark, rows, region):
    """Every category of every month within 1e-9 of the calculation by hand."""
    mine = [r for r in rows if r[1] == region]
    seen = sorted(expected(mine, 1)[3])
    cube = series.forecast_cube(spark.createDataFrame(mine, SCHEMA), AS_OF)
    found = categories.category_scores(categories.category_history(cube, AS_OF)).collect()
    by_month = {}
    for r in found:
        by_month.setdefault(r.month_number, {})[r.category] = r.score
    assert set(by_month) == (set(range(1, 13)) if seen else set())
    for month, own in by_month.items():
        assert own == pytest.approx(by_hand.scores(seen, month)[0], abs=1e-9)


def test_regions_and_texts(result):
    order = list(dict.fromkeys(r.region for r in result))
    assert order == [f"Region {i}" for i in range(1, 11)]
    method = {r.region: r.method for r in result}
    assert method["Region 2"] == (
        "Backtested seasonal-trend regression; limited-history validation")
    assert "; 12-month holdout MAE " in method["Region 3"]
    for r in result:
        if r.recordType == "Forecast":
            assert 0 <= r.lowerEstimate <= r.declarationRecords <= r.upperEstimate
        else:
            assert r.lowerEstimate is None and r.likelyIncidentType is None


def test_both_models_occur(result):
    assert len({"seasonal-naive" in r.method for r in result}) == 2


def test_forecast_arguments_and_sizes(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for bad in ({"horizon": 0}, {"horizon": 25}, {"history_months": 11}):
        with pytest.raises(ValueError):
            forecast.region_forecast(df, AS_OF, **bad)
    one = forecast.region_forecast(df, AS_OF, 6, 12, ["Region 4"])
    assert tuple(forecast.forecast_sizes(one).first()) == (1, 6)
    none = forecast.region_forecast(df.limit(0), AS_OF)
    assert none.isEmpty()


def test_gaps_are_filled_but_the_end_is_not(spark):
    counts = spark.createDataFrame(
        [("g", date(2020, 1, 1), 3), ("g", date(2020, 2, 1), 1), ("g", date(2020, 5, 1), 2),
         ("h", date(2019, 12, 1), 7)], "region string, month date, n bigint")
    filled = [tuple(r) for r in series.dense_series(counts).orderBy("region", "month").collect()]
    assert filled == [
        ("g", date(2020, 1, 1), 3, 0, 5), ("g", date(2020, 2, 1), 1, 1, 5),
        ("g", date(2020, 3, 1), 0, 2, 5), ("g", date(2020, 4, 1), 0, 3, 5),
        ("g", date(2020, 5, 1), 2, 4, 5), ("h", date(2019, 12, 1), 7, 0, 1)]


def test_december_history_supports_january(spark):
    cube = spark.createDataFrame(
        [("g", date(2018, 12, 1), "snow", "tx", 5), ("g", date(2019, 12, 1), "snow", "al", 1)],
        "region string, month date, category string, geo string, n bigint")
    found = {r.month_number: r for r in categories.category_estimates(cube, AS_OF).collect()}
    assert len(found) == 12
    assert found[1].likelyAreas == "AL, TX" and found[1].incidentTypeSupport == 100.0
    assert found[6].likelyIncidentType == "Snow" and found[6].likelyAreas == "AL, TX"
    assert found[12].incidentTypeConfidence == "Limited historical pattern"


def test_scores_sum_to_one(spark, rows):
    cube = series.forecast_cube(spark.createDataFrame(rows, SCHEMA), AS_OF)
    scores = categories.category_scores(categories.category_history(cube, AS_OF))
    for r in scores.groupBy("region", "month_number").agg(F.sum("score").alias("s")).collect():
        assert r.s == pytest.approx(1.0, abs=1e-9)


def test_backtest_reports_both_errors(spark, rows):
    dense = series.monthly_series(spark.createDataFrame(rows, SCHEMA), AS_OF)
    found = {r.region: r for r in models.backtest(dense).collect()}
    assert found["Region 2"].regression_mae is None and found["Region 2"].validation_mae is None
    assert found["Region 3"].validation_mae == min(
        found["Region 3"].regression_mae, found["Region 3"].seasonal_mae)
