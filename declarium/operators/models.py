"""The two volume models, their backtest, and the spread of their errors.

Everything starts from ``dense_series``, at most a few hundred rows per region, and stays
in column expressions: regions are rows and keys, never a loop.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from declarium.functions.dates import next_month
from declarium.functions.linear import dot, solve
from declarium.functions.numbers import seasonal_features
from declarium.schema import (
    BACKTEST_MINIMUM_MONTHS,
    HARMONICS,
    HOLDOUT_MONTHS,
    INTERVAL_WIDTH,
    LEVEL_BOUNDS,
    MAD_FACTOR,
    REGRESSION_HALF_LIFE,
    REGRESSION_MODEL,
    RIDGE,
    RMSE_FACTOR,
    SAME_MONTH_VALUES,
    SEASON_MONTHS,
    SEASONAL_MODEL,
    TRAINING_MONTHS,
)

FEATURES = 2 + 2 * HARMONICS
FULL, BACKTEST = "full", "backtest"
KEYS = ["region", "fit"]


def fit_rows(series: DataFrame) -> DataFrame:
    """The rows of each fit: the whole series, and the training window less its last year.

    ``rank`` counts back from the latest month a fit learns from; the held-back year has
    ranks 0, -1, … ``size`` is the number of months to learn from, and ``offset`` counts
    from the first month of the training window, which both fits share.
    """
    window = f"least(months, {TRAINING_MONTHS})"
    back = "months - position"
    offset = f"position - (months - {window})"
    return series.selectExpr("region", "month", "n", f"{back} AS back", f"{window} AS window",
                             f"{offset} AS offset", "months").selectExpr(
        "region",
        "month",
        "n",
        "offset",
        "window",
        f"""inline(filter(array(
            named_struct('fit', '{FULL}', 'rank', back, 'size', months),
            named_struct('fit', '{BACKTEST}', 'rank', back - {HOLDOUT_MONTHS},
                         'size', window - {HOLDOUT_MONTHS})),
            f -> f.fit = '{FULL}' OR (window >= {BACKTEST_MINIMUM_MONTHS} AND back <= window)))""",
    )


def learned(rows: DataFrame) -> DataFrame:
    return rows.where("rank >= 1")


def with_features(rows: DataFrame) -> DataFrame:
    """Adds log volume, recency weight (0 outside the training window) and the features."""
    features = seasonal_features("offset", "month(month)")
    return rows.selectExpr(
        "*",
        "log1p(n) AS y",
        f"if(rank BETWEEN 1 AND {TRAINING_MONTHS}, "
        f"pow(0.5D, (rank - 1) / {REGRESSION_HALF_LIFE}D), 0D) AS w",
        *[f"{feature} AS x{i}" for i, feature in enumerate(features)],
    )


def normal_equation_sums() -> list[Column]:
    """44 weighted sums: ``xx_i_j`` for i ≤ j, and ``xy_i``."""
    products = [
        F.expr(f"sum(w * x{i} * x{j}) AS xx_{i}_{j}")
        for i in range(FEATURES)
        for j in range(i, FEATURES)
    ]
    return products + [F.expr(f"sum(w * x{i} * y) AS xy_{i}") for i in range(FEATURES)]


def regression_sums(rows: DataFrame) -> DataFrame:
    """Normal-equation sums of each fit, with the origin and length of its training window."""
    training = with_features(learned(rows)).where("w > 0")
    return training.groupBy(*KEYS).agg(
        F.expr("min(add_months(month, -offset)) AS origin"),
        F.expr("count(*) AS training_months"),
        *normal_equation_sums(),
    )


def coefficients() -> Column:
    """Ridge solution of the normal-equation sums; the intercept is not penalised."""

    def entry(i: int, j: int) -> str:
        penalty = f" + {RIDGE}D" if i == j and i > 0 else ""
        return f"xx_{min(i, j)}_{max(i, j)}{penalty}"

    size = range(FEATURES)
    matrix = f"array({', '.join(f'array({", ".join(entry(i, j) for j in size)})' for i in size)})"
    return solve(matrix, f"array({', '.join(f'xy_{i}' for i in size)})")


def level_means() -> list[Column]:
    """Size of a fit and the means of its latest year and of the year before that."""
    return [
        F.expr("max(size) AS size"),
        F.expr(f"avg(n) FILTER (WHERE rank BETWEEN 1 AND {SEASON_MONTHS}) AS recent_mean"),
        F.expr(
            f"avg(n) FILTER (WHERE rank BETWEEN {SEASON_MONTHS + 1} AND {2 * SEASON_MONTHS}) "
            "AS previous_mean"
        ),
    ]


def level() -> Column:
    """How the latest year's level compares with the year before it, within bounds."""
    low, high = LEVEL_BOUNDS
    return F.expr(
        f"if(size >= {2 * SEASON_MONTHS} AND previous_mean > 0, "
        f"least(greatest(recent_mean / previous_mean, {low}D), {high}D), 1D)"
    )


def level_adjustment(rows: DataFrame) -> DataFrame:
    return learned(rows).groupBy(*KEYS).agg(*level_means()).withColumn("level", level())


def fitted_models(series: DataFrame) -> DataFrame:
    """One row per region and fit with all that either model needs.

    ``recent`` holds the latest values, newest first, as far as the seasonal model looks
    back, and ``window_values`` those of the training window (the holdout year before them,
    in the backtest): at most a few hundred numbers per region. The series is partitioned by
    region already, so this aggregation does not shuffle.
    """
    reach = SEASON_MONTHS * SAME_MONTH_VALUES
    fitted = with_features(fit_rows(series)).groupBy(*KEYS).agg(
        F.expr("min(add_months(month, -offset)) FILTER (WHERE rank >= 1) AS origin"),
        F.expr("max(month) FILTER (WHERE rank >= 1) AS last_month"),
        F.expr("max(month) AS trained_through"),
        F.expr("max(window) AS window"),
        F.expr("array_sort(collect_list(struct(rank, n)) "
               f"FILTER (WHERE rank <= {TRAINING_MONTHS})) AS ranked"),
        *level_means(),
        *normal_equation_sums(),
    )
    return fitted.select(
        *KEYS,
        "origin",
        "last_month",
        "trained_through",
        "window",
        "recent_mean",
        level().alias("level"),
        coefficients().alias("coefficients"),
        F.expr("transform(ranked, v -> v.n) AS window_values"),
        F.expr(f"transform(filter(ranked, v -> v.rank BETWEEN 1 AND {reach}), v -> v.n) AS recent"),
    )


def prediction_targets(as_of: date | str, horizon: int) -> str:
    """SQL: the months a fit predicts, as an array of structs.

    The backtest predicts the holdout year. The full fit predicts its training window
    (``step`` 0), where ``lagged`` is the value a year before, and the future (``step`` 1,
    2, …).
    """
    first = next_month(as_of).isoformat()
    held_out = f"""transform(slice(window_values, 1, {HOLDOUT_MONTHS}), (v, i) -> named_struct(
        'month', add_months(last_month, {HOLDOUT_MONTHS} - i), 'step', 0,
        'n', v, 'lagged', CAST(NULL AS BIGINT)))"""
    past = f"""transform(window_values, (v, i) -> named_struct(
        'month', add_months(last_month, -i), 'step', 0,
        'n', v, 'lagged', get(window_values, i + {SEASON_MONTHS})))"""
    future = f"""transform(sequence(1, {horizon}), s -> named_struct(
        'month', add_months(DATE '{first}', s - 1), 'step', s,
        'n', CAST(NULL AS BIGINT), 'lagged', CAST(NULL AS BIGINT)))"""
    return f"if(fit = '{BACKTEST}', {held_out}, concat({past}, {future}))"


def regression_prediction() -> Column:
    offset = "(year(month) - year(origin)) * 12 + month(month) - month(origin)"
    log_volume = dot(seasonal_features(offset, "month(month)"), "coefficients")
    return F.expr(f"greatest(0D, expm1({log_volume}))")


def seasonal_prediction() -> Column:
    """Weighted mean of the latest same-month values, the newest weighing most, times level.

    Same months lie whole years apart in ``recent``: the first at the distance that makes
    the target's distance a multiple of a year. With k values the weights are k, k-1, … 1.
    """
    ahead = "(year(month) - year(last_month)) * 12 + month(month) - month(last_month)"
    same = f"""filter(transform(sequence(0, {SAME_MONTH_VALUES - 1}),
        j -> get(recent, pmod(-({ahead}), {SEASON_MONTHS}) + {SEASON_MONTHS} * j)),
        v -> v IS NOT NULL)"""
    weighted = "aggregate(transform(same, (v, j) -> (size(same) - j) * v), 0L, (a, v) -> a + v)"
    base = f"if(size(same) > 0, {weighted} / (size(same) * (size(same) + 1) / 2), recent_mean)"
    return F.expr(f"if(step = 0 AND fit = '{FULL}', NULL, {same})").alias("same"), F.expr(
        f"greatest(0D, {base} * level)"
    )


def predictions(series: DataFrame, as_of: date | str, horizon: int) -> DataFrame:
    """Both models' predictions for every target month; the seasonal one outside training."""
    same_month, seasonal = seasonal_prediction()
    targets = fitted_models(series).select(
        *KEYS, "origin", "last_month", "trained_through", "window", "recent_mean", "level",
        "coefficients", "recent", F.expr(f"inline({prediction_targets(as_of, horizon)})"),
    )
    return targets.select("*", same_month).select(
        *KEYS, "month", "step", "n", "lagged", "window", "trained_through",
        regression_prediction().alias("regression"),
        seasonal.alias("seasonal"),
    )


def select_model(predicted: DataFrame) -> DataFrame:
    """Adds the holdout error of each model, the chosen model and its error.

    The seasonal model must be strictly better; without a holdout the regression is used
    and there is no error to report.
    """
    errors = [
        f"avg(if(fit = '{BACKTEST}', abs(n - {model}), NULL)) OVER (PARTITION BY region) "
        f"AS {model}_mae"
        for model in ["regression", "seasonal"]
    ]
    return predicted.selectExpr("*", *errors).selectExpr(
        "*",
        f"if(seasonal_mae < regression_mae, '{SEASONAL_MODEL}', '{REGRESSION_MODEL}') AS model",
        "if(seasonal_mae < regression_mae, seasonal_mae, regression_mae) AS validation_mae",
    )


def residual_scale(selected: DataFrame) -> DataFrame:
    """Adds the spread of the chosen model's errors in the training window, at least 1."""
    seasonal = f"model = '{SEASONAL_MODEL}' AND window > {SEASON_MONTHS}"
    residual = f"if(fit = '{FULL}' AND step = 0, n - if({seasonal}, lagged, regression), NULL)"
    by_region = "OVER (PARTITION BY region)"
    return (
        selected.selectExpr("*", f"{residual} AS residual")
        .selectExpr("*", f"median(residual) {by_region} AS centre")
        .selectExpr(
            "*",
            f"""greatest(1D,
                median(abs(residual - centre)) {by_region} * {MAD_FACTOR}D,
                sqrt(avg(residual * residual) {by_region}) * {RMSE_FACTOR}D) AS scale""",
        )
    )


def backtest(series: DataFrame) -> DataFrame:
    """The chosen model per region with both holdout errors, for reading the selection."""
    compared = select_model(predictions(series, date(1970, 1, 1), 1)).where("step = 1")
    return compared.select("region", "model", "regression_mae", "seasonal_mae", "validation_mae")


def volume_forecast(series: DataFrame, as_of: date | str, horizon: int) -> DataFrame:
    """Estimate and interval for every future month, with what the forecast was made from."""
    scaled = residual_scale(select_model(predictions(series, as_of, horizon)))
    estimated = scaled.where("step > 0").selectExpr(
        "*",
        f"if(model = '{SEASONAL_MODEL}', seasonal, regression) AS estimate",
        f"{INTERVAL_WIDTH}D * scale * sqrt(1D + step / 12D) AS uncertainty",
    )
    # rint rounds half to even.
    return estimated.selectExpr(
        "region",
        "month",
        "step",
        "CAST(rint(greatest(0D, estimate)) AS BIGINT) AS declarationRecords",
        "CAST(rint(greatest(0D, estimate - uncertainty)) AS BIGINT) AS lowerEstimate",
        "CAST(rint(greatest(0D, estimate + uncertainty)) AS BIGINT) AS upperEstimate",
        "model",
        "validation_mae",
        "trained_through",
    )
