from datetime import date, datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from declarium.functions import dates, numbers, text
from declarium.functions.linear import solve


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [row[0] for row in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_clean_text(spark):
    dirty = ["  tx ", "", "nan", " NaN", "None\t", "<NA>", None, " x　", "a b", "\n"]
    expected = ["tx", None, None, None, None, None, None, "x", "a b", None]
    assert column(spark, dirty, text.clean_text) == expected


def test_title_case_examples(spark):
    names = ["MUD/LANDSLIDE", "straight-line winds", "st. mary's (parish)", "a1b2 é_x", "", None,
             "中a", "ßx", "ᾳ"]
    assert column(spark, names, text.title_case) == [
        n.title() if n is not None else None for n in names
    ]


# Up to U+017F: beyond, the case tables of the Unicode versions in use differ (U+019B).
LETTERS = st.text(alphabet=st.characters(min_codepoint=32, max_codepoint=0x17F), max_size=20)


@settings(max_examples=5, deadline=None, derandomize=True)
@given(st.lists(LETTERS, min_size=150, max_size=150))
def test_title_case_equals_python(spark, texts):
    # U+0130 and U+0149 are spelled with a combining mark or a prefix by one side only.
    texts = [t for t in texts if not set(t) & set("İŉ")]
    assert column(spark, texts, text.title_case) == [t.title() for t in texts]


def test_labels(spark):
    assert column(spark, ["DR", "XX", None], lambda c: text.code_label(c, {"DR": "Major"})) == [
        "Major", "XX", "Not Reported"]
    numbers_ = ["4", "4.0", " 10 ", "4.5", "x", None, "1e1", "4d", "inf"]
    assert column(spark, numbers_, numbers.whole_number) == [
        4, 4, 10, None, None, None, 10, None, None]
    labels = column(spark, numbers_, lambda c: text.region_label(numbers.whole_number(c)))
    assert labels[:4] == ["Region 4", "Region 4", "Region 10", "Not Reported"]


def test_region_order(spark):
    labels = ["Region 10", "Not Reported", "Region 2", "Region 1", "Elsewhere"]
    df = spark.createDataFrame([(v,) for v in labels], "v string")
    ordered = [r.v for r in df.orderBy(text.region_order(F.col("v")), "v").collect()]
    assert ordered == ["Region 1", "Region 2", "Region 10", "Elsewhere", "Not Reported"]


def test_region_description(spark):
    assert column(spark, ["Region 5", "Region 11"], text.region_description) == [
        "Region 5 — Great Lakes (IL, IN, MI, MN, OH, WI)", "Region 11"]
    assert column(spark, ["Region 5"], lambda c: text.region_description(c, True)) == [
        "Region 5 — Great Lakes"]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_parse_utc_does_not_depend_on_the_session(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        values = ["2020-01-02T03:04:05.000Z", "2020-01-02", "2020-01-02 10:00:00", "bad", None,
                  "2020-07-01T00:30:00+02:00"]
        assert column(spark, values, dates.parse_utc) == [
            datetime(2020, 1, 2, 3, 4, 5), datetime(2020, 1, 2), datetime(2020, 1, 2, 10),
            None, None, datetime(2020, 6, 30, 22, 30)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_date_parts(spark):
    values = [datetime(2020, 12, 31, 23, 59, 59, 999999), None]
    parts = lambda f: column(spark, values, f, "timestamp_ntz")
    assert parts(dates.month_name) == ["December", None]
    assert parts(dates.month_text) == ["2020-12", None]
    assert parts(dates.date_key) == [20201231, None]
    assert parts(dates.month_start) == [date(2020, 12, 1), None]


def test_months():
    assert dates.next_month("2001-12-31") == date(2002, 1, 1)
    assert dates.shift_month(date(2001, 3, 1), -180) == date(1986, 3, 1)
    assert dates.month_floor(datetime(2001, 3, 9, 5)) == date(2001, 3, 1)


def test_circular_neighbours(spark):
    assert column(spark, [1, 6, 12], dates.previous_month_number, "int") == [12, 5, 11]
    assert column(spark, [1, 6, 12], dates.next_month_number, "int") == [2, 7, 1]


def test_rounding_and_decay(spark):
    assert column(spark, [2.5, 3.5, -0.5], numbers.half_even, "double") == [2.0, 4.0, 0.0]
    assert column(spark, [1, -5, 60], lambda c: numbers.decay(c, 60.0), "int") == [
        pytest.approx(0.5 ** (1 / 60)), 1.0, 0.5]


def test_solve(spark):
    rng = np.random.default_rng(7)
    a = rng.normal(size=(20, 8))
    matrix, right = a.T @ a + np.eye(8), rng.normal(size=8)
    df = spark.createDataFrame([(matrix.tolist(), right.tolist())],
                               "m array<array<double>>, r array<double>")
    found = df.select(solve("m", "r")).first()[0]
    assert np.allclose(found, np.linalg.solve(matrix, right), rtol=1e-11, atol=1e-12)
