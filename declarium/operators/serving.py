"""Serving a stored forecast, and comparing regions over the forecast period."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from declarium.functions.dates import month_text, next_month
from declarium.operators.filters import require_range
from declarium.operators.forecast import region_forecast
from declarium.operators.scale import broadcast_if_small, fixed
from declarium.operators.summaries import leading
from declarium.schema import FORECAST_TYPE_COLUMNS, PREFERRED_REGIONS, Columns


def serving_slice(
    stored: DataFrame, as_of: date | str, horizon: int = 12, history_months: int = 60
) -> DataFrame:
    """The stored rows to show, for the regions whose stored forecast is still usable.

    Shown are the last ``history_months`` historical months before the next month and the
    first ``horizon`` forecast months from it. Usable means: the forecast starts with the
    next month, has ``horizon`` months, and each of them names a category.
    """
    require_range("horizon", horizon, 1, 24)
    if not set(FORECAST_TYPE_COLUMNS) <= set(stored.columns):
        return stored.limit(0)
    floor = F.lit(next_month(as_of))
    dated = stored.withColumn("month", F.col("month").cast("date"))
    is_forecast = F.col("recordType") == "Forecast"
    in_time = (is_forecast & (F.col("month") >= floor)) | (
        (F.col("recordType") == "Historical") & (F.col("month") < floor)
    )
    # History counts back from the floor, the forecast forward from it.
    distance = F.abs(F.datediff(F.col("month"), floor))
    nearest = Window.partitionBy("region", "recordType").orderBy(distance)
    shown = (
        dated.where(in_time)
        .withColumn("_nth", F.row_number().over(nearest))
        .where(F.col("_nth") <= F.when(is_forecast, horizon).otherwise(history_months))
    )
    region = Window.partitionBy("region")
    usable = (
        (F.count_if(is_forecast).over(region) >= horizon)
        & (F.min(F.when(is_forecast, F.col("month"))).over(region) == floor)
        & (F.count_if(is_forecast & F.col("likelyIncidentType").isNull()).over(region) == 0)
    )
    return shown.withColumn("_usable", usable).where("_usable").drop("_usable", "_nth")


def serve(
    stored: DataFrame,
    recomputed: DataFrame,
    as_of: date | str,
    horizon: int = 12,
    history_months: int = 60,
) -> DataFrame:
    """Stored rows where usable, freshly computed ones for every other region.

    All columns of the computed rows; those that the stored table lacks are null in its rows.
    """
    kept = serving_slice(stored, as_of, horizon, history_months)
    rest = recomputed.join(kept.select("region").distinct(), "region", "left_anti")
    return rest.unionByName(kept, allowMissingColumns=True).select(recomputed.columns)


def serve_or_forecast(
    stored: DataFrame,
    records: DataFrame,
    as_of: date | str,
    horizon: int = 12,
    history_months: int = 60,
    columns: Columns = Columns(),
) -> DataFrame:
    """Stored rows of the regions whose stored forecast is usable; the others are forecast anew.

    The usable regions leave the records before anything is counted, so that a region costs
    nothing while its stored forecast holds. All columns of the forecast table, with its types;
    what the stored table lacks, or holds in a form that does not fit them, is null in its rows.
    """
    kept = fixed(serving_slice(stored, as_of, horizon, history_months))
    usable = broadcast_if_small(kept.select(F.col("region").alias("_usable")).distinct())
    rest = records.join(usable, F.col(columns.group) == F.col("_usable"), "left_anti")
    fresh = region_forecast(rest, as_of, horizon, history_months, columns=columns)
    types = dict(fresh.dtypes)
    shown = kept.select([F.col(c).try_cast(types[c]).alias(c) for c in kept.columns if c in types])
    return fresh.unionByName(shown, allowMissingColumns=True)


# Names in the served rows.
SERVED_NAMES = {
    "recordType": "record_type",
    "declarationRecords": "declaration_records",
    "lowerEstimate": "lower_estimate",
    "upperEstimate": "upper_estimate",
    "likelyIncidentType": "likely_incident_type",
    "incidentTypeSupport": "incident_type_support",
    "incidentTypeConfidence": "incident_type_confidence",
    "likelyAreas": "likely_areas",
    "incidentTypeMethod": "type_method",
    "incidentTypeLimitation": "type_limitation",
    "generatedAt": "generated_at",
    "asOfDate": "as_of_date",
    "trainingThrough": "training_through",
    "forecastStart": "forecast_start",
    "validationMae": "validation_mae",
}


def served_points(forecast: DataFrame) -> DataFrame:
    """Forecast rows under their served names, months as ``YYYY-MM``."""
    return forecast.withColumn("month", month_text(F.col("month"))).withColumnsRenamed(
        SERVED_NAMES
    )


def from_served(points: DataFrame) -> DataFrame:
    """Served rows back under their table names, months as dates."""
    month = F.concat(F.col("month"), F.lit("-01")).try_cast("date")
    return points.withColumn("month", month).withColumnsRenamed(
        {served: name for name, served in SERVED_NAMES.items()}
    )


def comparison_regions(forecast: DataFrame, count: int = 3) -> DataFrame:
    """The regions compared at first: the preferred ones that exist, then the others."""
    preference = F.array_position(
        F.array(*[F.lit(name) for name in PREFERRED_REGIONS]), F.col("region")
    )
    number = F.regexp_extract("region", r"(\d+)$", 1).try_cast("int")
    return (
        forecast.select("region").distinct()
        .orderBy(F.when(preference > 0, preference).otherwise(99), number, "region")
        .limit(count)
    )


def comparison(forecast: DataFrame, as_of: date | str) -> DataFrame:
    """Per region over its forecast months: total, average, peak, leading category, places.

    Ties: the earlier peak month, the smaller category name. The places are those of the
    leading category's first month.
    """
    ahead = forecast.where(
        (F.col("recordType") == "Forecast") & (F.col("month") >= F.lit(next_month(as_of)))
    ).select("region", "month", "declarationRecords", "likelyIncidentType", "likelyAreas")
    n = F.col("n")
    by_category = ahead.groupBy("region", F.col("likelyIncidentType").alias("category")).agg(
        F.sum("declarationRecords").alias("n"),
        F.count(F.lit(1)).alias("months"),
        leading(F.col("declarationRecords"), F.col("month")).alias("peak"),
        F.min(F.struct("month", "likelyAreas")).alias("first"),
    )
    peak_order = F.struct(F.col("peak.minus").alias("minus"), F.col("peak.key").alias("month"))
    totals = by_category.groupBy("region").agg(
        F.sum("n").alias("forecast_records"),
        (F.sum("n") / F.sum("months")).alias("average_month"),
        F.min(peak_order).alias("peak"),
        F.min(
            F.when(
                F.col("category").isNotNull(),
                F.struct((-n).alias("minus"), F.col("category"), F.col("first.likelyAreas")),
            )
        ).alias("best"),
    )
    return totals.select(
        "region",
        "forecast_records",
        "average_month",
        F.col("peak.month").alias("peak_month"),
        (-F.col("peak.minus")).alias("peak_records"),
        F.coalesce("best.category", F.lit("N/A")).alias("leading_incident_type"),
        F.coalesce("best.likelyAreas", F.lit("Region-wide")).alias("leading_areas"),
    )
