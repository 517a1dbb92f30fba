"""Every operator as a query on the order tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from declarium.functions import dates, numbers, text
from declarium.operators import (
    categories,
    filters,
    forecast,
    insights,
    models,
    normalise,
    profile,
    sampling,
    scale,
    serving,
    star,
    summaries,
)
from declarium.operators.series import forecast_cube, monthly_series
from declarium.plans.tables import (
    BROKEN_TITLE,
    COLUMNS,
    RAW,
    dirty_records,
    raw_records,
    records,
    table,
    with_places,
)
from declarium.schema import REGION_WIDE, SEASONAL_MODEL
from declarium.sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]

START, END = "1996-01-01", "2000-12-31"
REGION = "Region 2"
CATEGORIES = ["1-URGENT", "2-HIGH"]
AS_OF = "2001-08-15"
YEAR = 2001
HORIZON = 12

BY_PLACE = replace(COLUMNS, group="geo")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles at a fixed number of digits, so that the order of a sum does not show."""
    changed = {}
    for name, kind in df.dtypes:
        if kind == "double":
            value = F.round(name, digits)
            changed[name] = F.when(value == 0, 0.0).otherwise(value)
    return df.withColumns(changed)


def selected(spark: SparkSession, folder: str, places: bool = True) -> DataFrame:
    """Records of the date range and, with places, of the chosen region."""
    return filters.apply_filters(
        records(spark, folder, places), COLUMNS, START, END, groups=[REGION] if places else []
    )


# --- filters ---


def filter_records(spark, folder):
    chosen = filters.apply_filters(
        records(spark, folder), COLUMNS, START, END, groups=[REGION],
        categories=CATEGORIES, type_labels=["Filled", "P"],
    )
    return filters.listing(
        chosen, ["id", "entity", "recorded_at", "geo", "grp", "category", "type_label", "area"]
    )


def filter_years_swapped(spark, folder):
    """A last year before the first one stands for the first one alone."""
    first, last = filters.year_bounds(1999, 1997)
    chosen = filters.apply_filters(records(spark, folder, False), COLUMNS, first, last)
    return chosen.select("id", "recorded_at", "category")


def filter_years(spark, folder):
    first, last = filters.year_bounds(1997, 1999)
    chosen = filters.apply_filters(records(spark, folder, False), COLUMNS, first, last)
    return chosen.select("id", "recorded_at", "category")


def date_range_default(spark, folder):
    return filters.date_range(records(spark, folder, False), COLUMNS)


# --- summaries ---


def summary_kpis(spark, folder):
    return summaries.summary(selected(spark, folder), COLUMNS)


def trend_year(spark, folder):
    return summaries.trend(selected(spark, folder), "year", COLUMNS)


def trend_month(spark, folder):
    return summaries.trend(selected(spark, folder), "month", COLUMNS)


def trend_events_month(spark, folder):
    events = table(spark, folder, "events").select(F.col("ts").alias("recorded_at"))
    return summaries.trend(events, "month", COLUMNS)


def group_counts(spark, folder):
    chosen = filters.apply_filters(records(spark, folder), COLUMNS, START, END)
    return summaries.region_counts(chosen, COLUMNS)


def top_categories(spark, folder):
    return summaries.top_values(selected(spark, folder), "category", 3)


def top_geos(spark, folder):
    return summaries.top_values(records(spark, folder), "geo", 10)


def top_geo_category(spark, folder):
    return summaries.top_pairs(records(spark, folder), 25, COLUMNS)


def type_label_counts(spark, folder):
    counts = summaries.count_by(records(spark, folder, False), {"name": F.col("type_label")})
    return summaries.ranking(counts)


def month_counts(spark, folder):
    return summaries.month_counts(records(spark, folder, False), COLUMNS)


def seasonality(spark, folder):
    return summaries.seasonality(selected(spark, folder), COLUMNS)


def season_rollup(spark, folder):
    return summaries.season_totals(summaries.seasonality(selected(spark, folder), COLUMNS))


def metadata_values(spark, folder):
    return summaries.metadata(records(spark, folder), COLUMNS)


def record_cube(spark, folder):
    return summaries.record_cube(records(spark, folder), COLUMNS)


def shared_breakdowns(spark, folder):
    return summaries.breakdowns(records(spark, folder), COLUMNS)


# --- cleaning ---


def clean_text(spark, folder):
    documents = table(spark, folder, "documents")
    return documents.select(
        "doc_id",
        text.clean_text(F.col("text")).alias("cleaned"),
        text.or_not_reported(
            text.clean_text(F.when(F.col("lang") != "en", F.col("source")).otherwise(" NaN "))
        ).alias("filled"),
        F.upper(text.strip(F.concat(F.lit("\t"), F.col("lang"), F.lit(" \n")))).alias("code"),
    )


def title_case(spark, folder):
    documents = table(spark, folder, "documents")
    return documents.select("doc_id", text.title_case(F.col("text")).alias("title"))


def parse_cast(spark, folder):
    raw = raw_records(spark, folder)
    number = numbers.whole_number(F.col("region"))
    return raw.select(
        "id",
        number.alias("region"),
        text.region_label(number).alias("region_label"),
        numbers.whole_number(F.col("disasterNumber")).alias("entity"),
        dates.parse_utc(F.col("declarationDate")).alias("recorded_at"),
        dates.parse_utc(F.col("lastRefresh")).alias("refreshed_at"),
    )


def date_parts(spark, folder):
    when, month = F.col("recorded_at"), F.month("recorded_at")
    return records(spark, folder, False).select(
        "id",
        F.year(when).alias("year"),
        month.alias("month"),
        F.quarter(when).alias("quarter"),
        dates.month_name(when).alias("month_name"),
        dates.month_text(when).alias("month_year"),
        dates.date_key(when).alias("date_key"),
        when.cast("date").alias("full_date"),
        dates.month_start(when).alias("month_start"),
        F.add_months(dates.month_start(when), 1).alias("next_month"),
        dates.months_between(F.lit(dates.month_floor(AS_OF)), when).alias("age"),
        dates.previous_month_number(month).alias("month_before"),
        dates.next_month_number(month).alias("month_after"),
    )


def region_labels(spark, folder):
    label = F.col("grp")
    counts = summaries.count_by(records(spark, folder), {"grp": label})
    return counts.select(
        "grp",
        text.region_order(label).alias("region_order"),
        text.region_description(label).alias("description"),
        text.region_description(label, compact=True).alias("short_description"),
        summaries.RECORDS,
    )


def normalise_records(spark, folder):
    return normalise.normalise(raw_records(spark, folder))


def clean_records(spark, folder):
    return normalise.clean(raw_records(spark, folder))


LAST_ROW = [
    "lastRefresh", "disasterNumber", "declarationTitle", "declarationDate", "incidentType", "state",
    "designatedArea", "declarationType", "femaRegion", "designatedIncidentTypes",
]


def tidy_records(spark, folder):
    """Dirty raw records normalised; the order says which row of an id is the last."""
    return normalise.normalise(dirty_records(spark, folder), [F.col(c) for c in LAST_ROW])


def normalise_dirty(spark, folder):
    return tidy_records(spark, folder)


def clean_dirty(spark, folder):
    return normalise.clean(dirty_records(spark, folder))


def missing_columns(spark, folder):
    """A file that lacks required columns: they are there, without values."""
    raw = raw_records(spark, folder).drop("declarationType", "designatedArea", "region")
    return normalise.normalise(raw)


def last_refresh(spark, folder):
    return summaries.latest_refresh(tidy_records(spark, folder))


def group_counts_dirty(spark, folder):
    return summaries.region_counts(tidy_records(spark, folder))


def top_regions_dirty(spark, folder):
    """Regions less the records without one; fewer than asked for, as those are taken out last."""
    return summaries.top_reported(tidy_records(spark, folder), "femaRegion", 5)


def category_history_dirty(spark, folder):
    cube = forecast_cube(tidy_records(spark, folder), AS_OF)
    return rounded(categories.category_history(cube, AS_OF))


def dedupe_latest(spark, folder):
    lines = table(spark, folder, "lineitem")
    order = [F.col(c) for c in ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey",
                                "l_extendedprice", "l_quantity", "l_discount", "l_tax",
                                "l_returnflag", "l_linestatus"]]
    return normalise.latest_per_id(lines, "l_orderkey", order)


def repeated_lines(spark, folder):
    """All order lines, the first of each order twice, so that there are equal rows."""
    lines = table(spark, folder, "lineitem")
    return lines.unionByName(lines.where("l_linenumber = 1"))


def distinct_rows(spark, folder):
    return repeated_lines(spark, folder).dropDuplicates()


# --- profile ---


def profile_nulls(spark, folder):
    return profile.missing_values(normalise.typed(raw_records(spark, folder)), 15)


def profile_sizes(spark, folder):
    return profile.size_profile(repeated_lines(spark, folder))


def profile_removed(spark, folder):
    lines = repeated_lines(spark, folder)
    return profile.duplicates_removed(lines, lines.dropDuplicates())


def profile_columns(spark, folder):
    """The raw table's profile from one scan: years, types and places, missing values, dates."""
    typed = normalise.standard_case(normalise.typed(dirty_records(spark, folder)))
    return profile.table_profile(typed, "declarationDate", ["incidentType", "state"])


def findings(spark, folder):
    return profile.findings(records(spark, folder), COLUMNS)


def health(spark, folder):
    return profile.health(records(spark, folder, False), "Order tables", False)


def table_sizes(spark, folder):
    all_records = records(spark, folder)
    return profile.table_sizes(
        {
            "fact": all_records,
            "dim_date": star.dim_date(all_records, "recorded_at"),
            "dim_location": all_records.select("geo", "grp", "area").dropDuplicates(),
            "dim_category": all_records.select("category", "type_code").dropDuplicates(),
        }
    )


# --- star schema ---

LOCATION = ["geo", "grp", "region_number", "area"]
CATEGORY = ["category", "codes"]


def star_records(spark, folder):
    """Records whose area and codes are sometimes missing, as in the declarations."""
    return records(spark, folder).withColumns(
        {
            "area": F.nullif("area", F.lit("BUILDING")),
            "codes": F.nullif("type_code", F.lit("P")),
        }
    )


def dim_date(spark, folder):
    return star.dim_date(records(spark, folder, False), "recorded_at")


def dim_location(spark, folder):
    return star.keyed_dimension(star_records(spark, folder), LOCATION, "locationKey")


def dim_category(spark, folder):
    return star.keyed_dimension(star_records(spark, folder), CATEGORY, "incidentTypeKey")


def star_built(spark, folder):
    return star.build(star_records(spark, folder), LOCATION, CATEGORY, "recorded_at")


def fact_records(spark, folder):
    built = star_built(spark, folder)
    wanted = ["id", "entity", "type_label", "dateKey", "locationKey", "incidentTypeKey"]
    rows = star_records(spark, folder)
    return star.fact(rows, built.locations, built.incident_types, wanted, "recorded_at", checked=True)


def star_summary(spark, folder):
    built = star_built(spark, folder)
    facts = star.counted_facts(built)
    joined = star.denormalise(
        facts, built.dates, built.locations, built.incident_types, checked=True
    )
    keys = {name: F.col(name) for name in ["year", "grp", "category"]}
    return summaries.count_by(joined, keys, "n", "declarationCount")


def star_dimensions(spark, folder):
    """All dimensions of one star, as rows (dimension, key, natural keys)."""
    built = star_built(spark, folder)
    tables = {"date": built.dates, "location": built.locations, "kind": built.incident_types}
    rows = [
        df.select(
            F.lit(name).alias("dimension"),
            F.col(df.columns[0]).cast("long").alias("key"),
            F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in df.columns[1:]])
            .alias("natural_key"),
        )
        for name, df in tables.items()
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# --- samples ---


def sample_head(spark, folder):
    order = [F.col("recorded_at").desc_nulls_last(), F.col("id")]
    return sampling.head(records(spark, folder, False).select("id", "recorded_at"), order, 1000)


def sample_systematic(spark, folder):
    rows = records(spark, folder, False).select("id", "recorded_at", "category")
    return sampling.systematic(rows, "id", "recorded_at", 1000)


def head_per_group(spark, folder):
    rows = records(spark, folder).select("grp", "id", "recorded_at")
    return sampling.head_per_group(rows, "grp", [F.col("recorded_at"), F.col("id")], 12)


def first_of_regions(spark, folder):
    """More first rows of a group than Spark cuts before the shuffle of its own accord."""
    rows = records(spark, folder).select("grp", "id", "recorded_at")
    return sampling.head_per_group(rows, "grp", [F.col("recorded_at"), F.col("id")], 1500)


# --- files ---


def scratch(spark, name):
    return f"{scale.checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def newest_first_files(spark, folder):
    """The table written newest first, and the place of every row in its files."""
    rows = records(spark, folder, False).select("id", "recorded_at", "category")
    path = writers.write_newest_first(rows, scratch(spark, "newest"), COLUMNS)
    return writers.in_file_order(spark, path)


def broken_lines(spark, folder):
    """Raw records whose titles hold line breaks, written as CSV and read again."""
    raw = with_places(spark, folder).selectExpr(
        *[f"{BROKEN_TITLE if name == 'declarationTitle' else e} AS {name}" for name, e in RAW.items()]
    )
    path = writers.write_csv(raw, scratch(spark, "raw"))
    return readers.read_raw(spark, path).select("id", "declarationTitle", "state", "lastRefresh")


def exported_listing(spark, folder):
    """The listing of a filter, exported and read again; its dates typed."""
    chosen = filters.apply_filters(
        normalise.normalise(raw_records(spark, folder)), start=START, end=END, groups=["Region 3", "Region 4"]
    )
    back = readers.read_csv(spark, writers.export_listing(chosen, scratch(spark, "listing")))
    return back.withColumn("declarationDate", F.col("declarationDate").cast("timestamp_ntz"))


def exported_forecast(spark, folder):
    built = forecast.region_forecast(records(spark, folder), AS_OF, HORIZON, 12, columns=COLUMNS)
    path = writers.export_forecast(built, scratch(spark, "forecast"))
    return rounded(readers.read_forecast(spark, path))


def reread_forecast(spark, folder):
    """A stored forecast as CSV in which some months cannot be read."""
    stored = stored_forecast(spark, folder).withColumn(
        "month",
        F.when(F.month("month") % 5 == 0, "n/a").when(F.month("month") == 6, "2000-13-01")
        .otherwise(F.date_format("month", "yyyy-MM-dd")),
    )
    back = readers.read_forecast(spark, writers.write_csv(stored, scratch(spark, "stored")))
    return back.select("region", "month", "recordType", "declarationRecords", "likelyIncidentType")


def best_source(spark, folder):
    """Records by the source they come from: the store is missing, the first table empty, the
    second one no table, so the raw file is read, before any sample."""
    place = scratch(spark, "sources")
    raw = raw_records(spark, folder)
    tidy = normalise.normalise(raw)
    writers.write_full(tidy, f"{place}/curated/dashboard_dataset", is_sample=True)
    writers.write_csv(raw, f"{place}/cleaned/declarations_cleaned/_hidden")
    writers.write_csv(raw, f"{place}/raw/declarations_raw.csv")
    writers.write_table(tidy.limit(10), f"{place}/sample/dashboard_dataset_sample")
    candidates = readers.default_candidates(place, f"{place}/no_such_store")
    loaded = readers.load_best(spark, candidates).with_provenance()
    return loaded.groupBy("data_source", "sample_mode", "femaRegion").agg(
        F.count(F.lit(1)).alias("declaration_records")
    )


# --- insights ---


def insight_top_month(spark, folder):
    return insights.top_month(summaries.seasonality(selected(spark, folder), COLUMNS))


def insight_top_season(spark, folder):
    season = insights.top_season(summaries.seasonality(selected(spark, folder), COLUMNS))
    return season.withColumn("months", F.array_join("months", ", "))


def insight_top_regions(spark, folder):
    return summaries.top_reported(records(spark, folder), "grp", 5)


def insight_trend(spark, folder):
    return insights.long_term_trend(records(spark, folder, False), YEAR, COLUMNS)


def insight_spikes(spark, folder):
    return insights.spikes(records(spark, folder, False), YEAR, COLUMNS)


def insight_records_vs_entities(spark, folder):
    return insights.records_per_entity(selected(spark, folder), COLUMNS)


def insights_all(spark, folder):
    chosen = records(spark, folder)
    cube = scale.fixed(summaries.record_cube(chosen, COLUMNS))
    return insights.insight_rows(insights.insights(chosen, YEAR, COLUMNS, cube))


def insight_trend_from_cube(spark, folder):
    cube = summaries.record_cube(records(spark, folder), COLUMNS)
    return rounded(insights.long_term_trend(cube, YEAR, COLUMNS, "records", fallback=False))


def totals_findings(spark, folder):
    """All findings from published totals."""
    chosen = records(spark, folder)
    totals = {
        "summary": summaries.summary(chosen, COLUMNS),
        "years": summaries.trend(chosen, "year", COLUMNS),
        "months": summaries.seasonality(chosen, COLUMNS),
        "states": summaries.top_values(chosen, "geo", 10),
        "incident_types": summaries.top_values(chosen, "category", 10),
        "regions": summaries.region_counts(chosen, COLUMNS),
    }
    return insights.insight_rows(insights.insights_from_totals(totals, YEAR))


def empty_results(spark, folder):
    """Rows that every operator gives for a selection without records."""
    none = filters.apply_filters(records(spark, folder), COLUMNS, geos=["NOWHERE"])
    results = {
        "summary": summaries.summary(none, COLUMNS),
        "trend": summaries.trend(none, "month", COLUMNS),
        "top_values": summaries.top_values(none, "category", 5),
        "region_counts": summaries.region_counts(none, COLUMNS),
        "metadata": summaries.metadata(none, COLUMNS),
        "seasonality": summaries.seasonality(none, COLUMNS),
        "findings": profile.findings(none, COLUMNS),
        "date_range": filters.date_range(none, COLUMNS),
        "forecast": forecast.region_forecast(none, AS_OF, HORIZON, 12, columns=COLUMNS),
    } | {f"insights.{k}": v for k, v in insights.insights(none, YEAR, COLUMNS).items()}
    sizes = profile.table_sizes(results)
    return sizes.select(F.replace("metric", F.lit("rows:"), F.lit("")).alias("result"), "value")


# --- series and models ---


def monthly_series_region(spark, folder):
    return monthly_series(records(spark, folder), AS_OF, COLUMNS)


def monthly_series_place(spark, folder):
    return monthly_series(records(spark, folder), AS_OF, BY_PLACE)


def seasonal_naive(spark, folder):
    series = monthly_series(records(spark, folder), AS_OF, BY_PLACE)
    future = models.predictions(series, AS_OF, HORIZON).where("step > 0")
    return rounded(future.select("region", "month", "seasonal"))


def level_adjustment(spark, folder):
    rows = models.fit_rows(monthly_series(records(spark, folder), AS_OF, BY_PLACE))
    return rounded(models.level_adjustment(rows))


def lag_residual_scale(spark, folder):
    series = monthly_series(records(spark, folder), AS_OF, BY_PLACE)
    predicted = models.predictions(series, AS_OF, 1)
    scaled = models.residual_scale(predicted.withColumn("model", F.lit(SEASONAL_MODEL)))
    return rounded(scaled.where("step = 1").select("region", "scale"))


def regression_sums(spark, folder):
    rows = models.fit_rows(monthly_series(records(spark, folder), AS_OF, COLUMNS))
    return rounded(models.regression_sums(rows))


def regression_forecast(spark, folder):
    series = monthly_series(records(spark, folder), AS_OF, BY_PLACE)
    future = models.predictions(series, AS_OF, HORIZON).where("step > 0")
    return rounded(future.select("region", "month", "regression"))


def backtest_selection(spark, folder):
    return rounded(models.backtest(monthly_series(records(spark, folder), AS_OF, BY_PLACE)))


def volume_forecast(spark, folder):
    series = monthly_series(records(spark, folder), AS_OF, BY_PLACE)
    return rounded(models.volume_forecast(series, AS_OF, HORIZON))


# --- categories ---


def category_history(spark, folder):
    cube = forecast_cube(records(spark, folder), AS_OF, COLUMNS)
    return rounded(categories.category_history(cube, AS_OF))


def category_scores(spark, folder):
    cube = forecast_cube(records(spark, folder), AS_OF, COLUMNS)
    scores = categories.category_scores(categories.category_history(cube, AS_OF))
    return rounded(scores.drop("seen_nearby"), 9)


def category_estimates(spark, folder):
    cube = forecast_cube(records(spark, folder), AS_OF, COLUMNS)
    return categories.category_estimates(cube, AS_OF)


# --- forecast ---


def group_forecast(spark, folder):
    return rounded(
        forecast.region_forecast(records(spark, folder), AS_OF, HORIZON, 60, columns=COLUMNS)
    )


def one_group_forecast(spark, folder):
    table_ = forecast.region_forecast(
        records(spark, folder), AS_OF, 6, 24, [REGION], columns=COLUMNS
    )
    return rounded(serving.served_points(table_))


def stored_forecast(spark, folder):
    """A stored table made of observed months, so that what is served depends on data alone.

    Places are the regions here. Months far below a place's average name no category, which
    makes the stored forecast of some places unusable.
    """
    series = monthly_series(records(spark, folder), AS_OF, BY_PLACE)
    is_forecast = F.col("month") >= F.lit(dates.next_month(STORED_AS_OF))
    busy = F.col("n") * 2 >= F.avg("n").over(Window.partitionBy("region"))
    extra = {name: F.lit("-") for name in
             ["incidentTypeConfidence", "incidentTypeMethod", "incidentTypeLimitation"]}
    return series.select(
        "region",
        "month",
        F.when(is_forecast, "Forecast").otherwise("Historical").alias("recordType"),
        F.col("n").cast("long").alias("declarationRecords"),
        F.when(is_forecast & busy, "Some").alias("likelyIncidentType"),
        F.lit(1.0).alias("incidentTypeSupport"),
        F.lit(REGION_WIDE).alias("likelyAreas"),
    ).withColumns(extra)


STORED_AS_OF = "1999-05-10"


def forecast_serving_slice(spark, folder):
    shown = serving.serving_slice(stored_forecast(spark, folder), STORED_AS_OF, 6, 24)
    return shown.select("region", "month", "recordType", "declarationRecords", "likelyIncidentType")


def served_forecast(spark, folder):
    """Stored rows of usable regions; the others forecast from the records, as of the same day."""
    stored = stored_forecast(spark, folder)
    shown = serving.serve_or_forecast(
        stored, records(spark, folder), STORED_AS_OF, 6, 24, columns=BY_PLACE
    )
    return rounded(
        shown.select(
            "region", "month", "recordType", "declarationRecords", "lowerEstimate", "upperEstimate",
            "likelyIncidentType", "incidentTypeSupport", "likelyAreas", "method", "validationMae",
        )
    )


def forecast_comparison(spark, folder):
    return rounded(serving.comparison(forecast_small(spark, folder), AS_OF))


def forecast_small(spark, folder):
    return forecast.region_forecast(records(spark, folder), AS_OF, HORIZON, 12, columns=COLUMNS)


def comparison_regions(spark, folder):
    chosen = records(spark, folder).select(F.col("grp").alias("region"))
    return serving.comparison_regions(chosen)


def forecast_sizes(spark, folder):
    return forecast.forecast_sizes(forecast_small(spark, folder))


QUERIES: dict[str, Query] = {
    function.__name__: function
    for function in [
        filter_records, filter_years, filter_years_swapped, date_range_default,
        summary_kpis, trend_year, trend_month, trend_events_month, group_counts,
        top_categories, top_geos, top_geo_category, type_label_counts, month_counts,
        seasonality, season_rollup, metadata_values, record_cube, shared_breakdowns,
        clean_text, title_case, parse_cast, date_parts, region_labels,
        normalise_records, clean_records, normalise_dirty, clean_dirty, missing_columns, last_refresh,
        group_counts_dirty, top_regions_dirty, category_history_dirty, dedupe_latest, distinct_rows,
        profile_nulls, profile_sizes, profile_removed, profile_columns, findings, health, table_sizes,
        dim_date, dim_location, dim_category, fact_records, star_summary, star_dimensions,
        sample_head, sample_systematic, head_per_group, first_of_regions,
        newest_first_files, broken_lines, exported_listing, exported_forecast, reread_forecast,
        best_source,
        insight_top_month, insight_top_season, insight_top_regions, insight_trend,
        insight_spikes, insight_records_vs_entities, insights_all, insight_trend_from_cube,
        totals_findings, empty_results,
        monthly_series_region, monthly_series_place, seasonal_naive, level_adjustment,
        lag_residual_scale, regression_sums, regression_forecast, backtest_selection,
        volume_forecast, category_history, category_scores, category_estimates,
        group_forecast, one_group_forecast, forecast_serving_slice, served_forecast,
        forecast_comparison,
        comparison_regions, forecast_sizes,
    ]
}
