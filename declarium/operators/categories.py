"""Which category, and which places, a region's calendar month has seen most."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from declarium.functions.dates import (
    month_floor,
    months_between,
    shift_month,
)
from declarium.functions.numbers import decay
from declarium.functions.text import strip, title_case
from declarium.schema import (
    BLEND,
    CATEGORY_HALF_LIFE,
    LIMITED,
    MODERATE,
    NEIGHBOUR_AREA_WEIGHT,
    NOT_REPORTED,
    REGION_WIDE,
    STRONG,
    TRAINING_MONTHS,
)

EXACT, NEIGHBOUR, OVERALL = "exact", "neighbour", "overall"
# Scores are compared at this many digits, so that equal scores tie whatever the order in
# which they were summed; ties go to the smaller name.
SCORE_DIGITS = 12
TARGET = "(PARTITION BY region, other)"
# The training window spans at most 16 years, so a year's last digits in a 64-bit set tell
# the years apart; sets of years then add up at a fixed size.
YEAR_BIT = "shiftleft(1L, year(m.month) % 64)"


def category_history(cube: DataFrame, as_of: date | str) -> DataFrame:
    """Distinct occurrences (region, month, category, geo) with their recency weight.

    ``cube`` has those columns, however often each combination; text is cleaned here, on
    the small table, not per record.
    """
    floor = month_floor(as_of)
    category = title_case(strip(F.col("category")))
    place = F.upper(strip(F.col("geo")))
    unnamed = place.isNull() | place.isin("", NOT_REPORTED.upper())
    age = months_between(F.lit(floor), F.col("month"))
    return (
        cube.where(
            (F.col("month") >= F.lit(shift_month(floor, -TRAINING_MONTHS)))
            & (F.col("month") < F.lit(floor))
        )
        .select(
            "region",
            "month",
            category.alias("category"),
            F.when(unnamed, REGION_WIDE).otherwise(place).alias("geo"),
        )
        .where(F.col("category").isNotNull() & ~F.col("category").isin("", NOT_REPORTED))
        .dropDuplicates()
        .withColumn("weight", decay(age, CATEGORY_HALF_LIFE))
    )


def related_months(month_number: str) -> str:
    """SQL: the calendar months a month bears on, as an array of (role, other)."""
    before, after = f"pmod({month_number} - 2, 12) + 1", f"pmod({month_number}, 12) + 1"
    return f"""array(
        named_struct('role', '{EXACT}', 'other', {month_number}),
        named_struct('role', '{NEIGHBOUR}', 'other', {before}),
        named_struct('role', '{NEIGHBOUR}', 'other', {after}))"""


def every_month() -> str:
    return f"transform(sequence(1, 12), m -> named_struct('role', '{OVERALL}', 'other', m))"


def blend_weight(position: int) -> str:
    """SQL: weight of the exact month (position 1) or its neighbours (2), by years seen."""
    cases = " ".join(f"WHEN exact_years >= {entry[0]} THEN {entry[position]}D" for entry in BLEND)
    return f"CASE {cases} END"


def category_scores(history: DataFrame) -> DataFrame:
    """Share of every category in every calendar month of a region.

    A blend of the shares in the month itself, in its neighbours and over the whole year.
    ``category_years`` counts the years that saw the category in that very month.
    """
    # A category's months in one calendar month: at most one per training year.
    by_month = history.groupBy(
        "region", F.month("month").alias("month_number"), "category"
    ).agg(F.expr("collect_set(struct(month, weight)) AS months"))
    weighed = by_month.selectExpr(
        "region",
        "category",
        f"aggregate(months, 0L, (years, m) -> years | {YEAR_BIT}) AS seen",
        "aggregate(months, 0D, (total, m) -> total + m.weight) AS weight",
        f"inline(concat({related_months('month_number')}, {every_month()}))",
    )
    # One shuffle by target month serves the sums per category and the totals over them.
    shares = (
        weighed.repartition("region", "other")
        .groupBy("region", "other", "category")
        .agg(
            F.expr(f"sum(weight) FILTER (WHERE role = '{EXACT}') AS exact"),
            F.expr(f"sum(weight) FILTER (WHERE role = '{NEIGHBOUR}') AS near"),
            F.expr(f"sum(weight) FILTER (WHERE role = '{OVERALL}') AS overall"),
            F.expr(f"coalesce(bit_or(seen) FILTER (WHERE role = '{EXACT}'), 0L) AS seen"),
        )
        .selectExpr(
            "*",
            *[f"sum({role}) OVER {TARGET} AS {role}_total" for role in ["exact", "near", "overall"]],
            f"bit_count(bit_or(seen) OVER {TARGET}) AS exact_years",
        )
        .selectExpr(
            "*",
            f"{blend_weight(1)} AS exact_part",
            f"if(near_total IS NULL, 0D, {blend_weight(2)}) AS near_part",
        )
    )
    score = """coalesce(exact / exact_total, 0D) * exact_part
        + coalesce(near / near_total, 0D) * near_part
        + overall / overall_total * (1D - exact_part - near_part)"""
    return shares.selectExpr(
        "region", "other AS month_number", "category", "exact", "near", "seen",
        f"{score} AS score",
    ).selectExpr(
        "region",
        "month_number",
        "category",
        "round(score / sum(score) OVER (PARTITION BY region, month_number), "
        f"{SCORE_DIGITS}) AS score",
        "CAST(bit_count(seen) AS BIGINT) AS category_years",
        "exact IS NOT NULL OR near IS NOT NULL AS seen_nearby",
    )


def likely_categories(scores: DataFrame) -> DataFrame:
    """The leading category per region and calendar month, with support and confidence."""
    best = "PARTITION BY region, month_number ORDER BY score DESC, category"
    support = "score * 100"
    return (
        scores.selectExpr("*", f"row_number() OVER ({best}) AS place")
        .where("place = 1")
        .selectExpr(
            "region",
            "month_number",
            "category AS likelyIncidentType",
            f"bround({support}, 1) AS incidentTypeSupport",
            f"""CASE WHEN {support} >= 50 AND category_years >= 5 THEN '{STRONG}'
                WHEN {support} >= 32 AND category_years >= 3 THEN '{MODERATE}'
                ELSE '{LIMITED}' END AS incidentTypeConfidence""",
            "seen_nearby",
        )
    )


def with_areas(likely: DataFrame, history: DataFrame) -> DataFrame:
    """Adds up to three places that saw the likely category most, as one text.

    Places seen in the month or its neighbours count; only if the category was not seen
    there at all, those of the whole year do.
    """
    places = (
        history.where(F.col("geo") != REGION_WIDE)
        .groupBy("region", "category", F.month("month").alias("other"), "geo")
        .agg(F.sum("weight").alias("weight"))
    )
    found = likely.selectExpr(
        "*",
        "likelyIncidentType AS category",
        f"inline(if(seen_nearby, {related_months('month_number')}, {every_month()}))",
    ).join(places, ["region", "category", "other"], "left")
    kept = ["region", "month_number", "likelyIncidentType", "incidentTypeSupport",
            "incidentTypeConfidence"]
    weight = f"weight * if(role = '{NEIGHBOUR}', {NEIGHBOUR_AREA_WEIGHT}D, 1D)"
    best = "PARTITION BY region, month_number ORDER BY score DESC NULLS LAST, geo"
    # Without any place the one row with a NULL place keeps the month.
    ranked = (
        found.groupBy(*kept, "geo")
        .agg(F.expr(f"round(sum({weight}), {SCORE_DIGITS}) AS score"))
        .selectExpr("*", f"row_number() OVER ({best}) AS place")
        .where("place <= 3")
    )
    listed = """array_join(transform(array_sort(
        collect_list(struct(place, geo)) FILTER (WHERE geo IS NOT NULL)), p -> p.geo), ', ')"""
    return ranked.groupBy(*kept).agg(
        F.expr(f"coalesce(nullif({listed}, ''), '{REGION_WIDE}') AS likelyAreas")
    )


def category_estimates(cube: DataFrame, as_of: date | str) -> DataFrame:
    """Likely category and places for each calendar month of every region with history."""
    history = category_history(cube, as_of)
    return with_areas(likely_categories(category_scores(history)), history)
