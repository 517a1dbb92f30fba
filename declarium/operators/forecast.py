"""The forecast table: history and estimates of every region."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from declarium.functions.dates import as_date, next_month
from declarium.functions.text import region_order
from declarium.operators.categories import category_estimates
from declarium.operators.filters import require_range
from declarium.operators.models import volume_forecast
from declarium.operators.scale import fixed
from declarium.operators.series import dense_series, forecast_cube
from declarium.schema import (
    CATEGORY_LIMITATION,
    CATEGORY_METHOD,
    FORECAST_COLUMNS,
    LIMITED,
    NO_HISTORY,
    REGION_WIDE,
    Columns,
)


def region_forecast(
    records: DataFrame,
    as_of: date | str,
    horizon: int = 12,
    history_months: int = 60,
    regions: Iterable[str] = (),
    generated_at: str | None = None,
    columns: Columns = Columns(),
) -> DataFrame:
    """Historical and forecast months of all regions, or of the given ones, 18 columns.

    Regions are a grouping key. The records are scanned once, into a cube that is fixed so
    that volumes and categories share it. Regions without completed history have no rows.
    """
    require_range("horizon", horizon, 1, 24)
    require_range("history_months", history_months, 12)
    chosen = list(regions)
    if chosen:
        records = records.where(F.col(columns.group).isin(chosen))
    cube = fixed(forecast_cube(records, as_of, columns))
    return forecast_from_cube(cube, as_of, horizon, history_months, generated_at)


def forecast_from_cube(
    cube: DataFrame,
    as_of: date | str,
    horizon: int = 12,
    history_months: int = 60,
    generated_at: str | None = None,
) -> DataFrame:
    require_range("horizon", horizon, 1, 24)
    require_range("history_months", history_months, 12)
    counts = cube.groupBy("region", "month").agg(F.sum("n").alias("n"))
    series = dense_series(counts)
    volumes = volume_forecast(series, as_of, horizon).withColumn(
        "month_number", F.month("month")
    )
    estimates = category_estimates(cube, as_of)
    future = volumes.join(estimates, ["region", "month_number"], "left").selectExpr(
        "region",
        "month",
        "'Forecast' AS recordType",
        "declarationRecords",
        "lowerEstimate",
        "upperEstimate",
        f"coalesce(likelyIncidentType, '{NO_HISTORY}') AS likelyIncidentType",
        "coalesce(incidentTypeSupport, 0D) AS incidentTypeSupport",
        f"coalesce(incidentTypeConfidence, '{LIMITED}') AS incidentTypeConfidence",
        f"coalesce(likelyAreas, '{REGION_WIDE}') AS likelyAreas",
        "model",
        "validation_mae",
        "trained_through",
    )
    past = series.where(f"months - position <= {history_months}").selectExpr(
        "region", "month", "'Historical' AS recordType", "CAST(n AS BIGINT) AS declarationRecords"
    )
    by_region = "OVER (PARTITION BY region)"
    constants = {
        "incidentTypeMethod": CATEGORY_METHOD,
        "incidentTypeLimitation": CATEGORY_LIMITATION,
        "generatedAt": generated_at or f"{as_date(as_of)}T00:00:00+00:00",
        "asOfDate": as_date(as_of).isoformat(),
        "forecastStart": next_month(as_of).isoformat()[:7],
    }
    # The constants of a region stand on its forecast rows only; spread them to its history.
    spread = past.unionByName(future, allowMissingColumns=True).selectExpr(
        *past.columns,
        "lowerEstimate", "upperEstimate", "likelyIncidentType", "incidentTypeSupport",
        "incidentTypeConfidence", "likelyAreas",
        f"max(model) {by_region} AS model",
        f"max(validation_mae) {by_region} AS validationMae",
        f"substring(CAST(max(trained_through) {by_region} AS STRING), 1, 7) AS trainingThrough",
    )
    return spread.select(
        "*",
        F.expr(METHOD_TEXT).alias("method"),
        *[F.lit(value).alias(name) for name, value in constants.items()],
    ).select(FORECAST_COLUMNS)


METHOD_TEXT = """concat('Backtested ', model, if(validationMae IS NULL,
    '; limited-history validation',
    format_string('; 12-month holdout MAE %.1f records', bround(validationMae, 1))))"""


def in_region_order(forecast: DataFrame) -> DataFrame:
    """Sorted for a sink: regions by number, history before forecast."""
    return forecast.orderBy(region_order(F.col("region")), "region", "month")


def forecast_sizes(forecast: DataFrame) -> DataFrame:
    """Regions forecast and forecast rows made."""
    return forecast.agg(
        F.countDistinct("region").alias("regions_forecasted"),
        F.count_if(F.col("recordType") == "Forecast").alias("forecast_rows"),
    )
