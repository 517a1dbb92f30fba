"""The batch pipeline: raw file to cleaned, star, summary, dashboard and forecast tables.

One session does what used to be a chain of scripts handing over files; Parquet between the
stages keeps the types. Run with spark-submit:

    python -m declarium.plans.pipeline RAW_CSV OUTPUT_FOLDER AS_OF
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from declarium.functions.dates import as_date
from declarium.operators import (
    forecast,
    insights,
    normalise,
    profile,
    sampling,
    serving,
    star,
    summaries,
)
from declarium.operators.scale import fixed
from declarium.schema import YEAR_FOLDER, Columns
from declarium.sources import readers, writers

COLUMNS = Columns()
COUNT = "declarationCount"


def land_stage(spark: SparkSession, raw_path: str, folder: str) -> DataFrame:
    """The raw file as a table of texts; every later stage reads its columns, none the file."""
    path = writers.write_table(readers.read_raw(spark, raw_path), f"{folder}/landed/declarations")
    return spark.read.parquet(path)


def profile_stage(raw: DataFrame, folder: str) -> dict[str, DataFrame]:
    """Sizes, date range, missing values and top values of the raw table.

    One scan counts everything but equal rows, into a small table that all outputs are cut from.
    """
    typed = normalise.with_date_parts(
        normalise.typed(normalise.ensure_columns(raw, ["declarationDate"]))
    )
    values = {"incidentType": "top_incident_types", "state": "top_states"}
    values = {column: name for column, name in values.items() if column in typed.columns}
    found = fixed(profile.table_profile(typed, "declarationDate", list(values)))

    def part(metric: str, name: str, count: str) -> DataFrame:
        return found.where(F.col("metric") == metric).select(
            F.col("name").alias(name), F.col("n").alias(count)
        )

    years = part("year", "declarationYear", "count")
    tables = {
        "profile_sizes": profile.size_profile(raw),
        "profile_dates": found.agg(
            F.max(F.when(F.col("metric") == "earliest", F.col("at"))).alias("earliest"),
            F.max(F.when(F.col("metric") == "latest", F.col("at"))).alias("latest"),
        ),
        "profile_missing": part("missing", "column", "missing")
        .orderBy(F.col("missing").desc(), "column")
        .limit(15),
        "declarations_by_year": years.withColumn(
            "declarationYear", F.col("declarationYear").cast("int")
        ).orderBy("declarationYear"),
    }
    for column, name in values.items():
        tables[name] = summaries.ranking(part(column, column, "count"), 10, "count")
    for name, df in tables.items():
        writers.write_csv(df.coalesce(1), f"{folder}/sample/{name}")
    return tables


def clean_stage(raw: DataFrame, folder: str) -> DataFrame:
    path = writers.write_table(normalise.clean(raw), f"{folder}/cleaned/declarations_cleaned")
    cleaned = raw.sparkSession.read.parquet(path)
    order = [F.col("declarationDate").desc_nulls_last(), F.xxhash64(*cleaned.columns)]
    writers.write_review_sample(cleaned, order, f"{folder}/sample/declarations_cleaned_sample")
    return cleaned


def star_stage(cleaned: DataFrame, folder: str) -> tuple[dict[str, DataFrame], star.Star]:
    """The star's tables, and the star they were written from.

    The cleaned table is read twice: once to count its natural keys, once for the facts.
    """
    spark = cleaned.sparkSession
    keys = {
        "dim_date": "dateKey",
        "dim_location": "locationKey",
        "dim_incident_type": "incidentTypeKey",
    }
    built = star.build(cleaned)
    made = [built.dates, built.locations, built.incident_types]
    tables = {}
    for name, df in zip(keys, made):
        tables[name] = spark.read.parquet(writers.write_table(df, f"{folder}/curated/{name}"))
        writers.write_review_sample(
            tables[name], [F.col(keys[name])], f"{folder}/sample/{name}_sample"
        )
    facts = star.fact(cleaned, built.locations, built.incident_types, checked=True)
    path = writers.write_table(facts, f"{folder}/curated/fact_declarations")
    tables["fact_declarations"] = spark.read.parquet(path)
    order = [F.col(name) for name in ["dateKey", "locationKey", "incidentTypeKey"]]
    writers.write_review_sample(
        tables["fact_declarations"], order, f"{folder}/sample/fact_declarations_sample"
    )
    return tables, built


def analysis_tables(joined: DataFrame, weight: str | None = None) -> dict[str, DataFrame]:
    """The six summaries of the joined star, all from one count over it, made once."""
    keys = ["year", "month", "monthName", "incidentType", "state", "femaRegion"]
    cube = fixed(joined.groupBy(*keys).agg(summaries.tally(weight).alias("n")))

    def counted(*names: str) -> DataFrame:
        return summaries.count_by(cube, {n: F.col(n) for n in names}, "n", COUNT)

    return {
        "analysis_declarations_by_year": counted("year").orderBy("year"),
        "analysis_declarations_by_month": counted("month", "monthName").orderBy("month"),
        "analysis_declarations_by_incident_type": summaries.ranking(
            counted("incidentType"), name=COUNT
        ),
        "analysis_declarations_by_state": summaries.ranking(counted("state"), name=COUNT),
        "analysis_declarations_by_region": summaries.ranking(counted("femaRegion"), name=COUNT),
        "analysis_top_state_incident_mix": summaries.ranking(
            counted("state", "incidentType"), 25, COUNT
        ),
    }


def analysis_stage(
    tables: dict[str, DataFrame], built: star.Star, folder: str
) -> dict[str, DataFrame]:
    """Summaries of the joined star: its dimensions meet the counted facts, not every record."""
    facts = star.counted_facts(built)
    joined = star.denormalise(
        facts, built.dates, built.locations, built.incident_types, checked=True
    )
    results = analysis_tables(joined, "n")
    results["table_sizes"] = profile.table_sizes(tables)
    for name, df in results.items():
        writers.write_csv(df.coalesce(1), f"{folder}/sample/{name}")
    return results


def dashboard_stage(loaded: readers.Loaded, folder: str) -> DataFrame:
    """The flat table and its evenly spread sample of a thousand rows."""
    path = writers.write_full(
        loaded.records, f"{folder}/curated/dashboard_dataset", loaded.is_sample
    )
    spark = loaded.records.sparkSession
    records = spark.read.parquet(path) if path else loaded.records
    sample = sampling.systematic(records.drop(YEAR_FOLDER), "id", "declarationDate", 1000)
    writers.write_table(sample.coalesce(1), f"{folder}/sample/dashboard_dataset_sample")
    findings = profile.findings(records, COLUMNS)
    writers.write_csv(findings.coalesce(1), f"{folder}/sample/findings")
    return records


def insight_stage(records: DataFrame, folder: str, current_year: int) -> dict[str, DataFrame]:
    """All key findings, from a cube written once and one pass for the entity count."""
    path = writers.write_table(
        summaries.record_cube(records, COLUMNS), f"{folder}/curated/record_cube"
    )
    cube = records.sparkSession.read.parquet(path)
    found = insights.insights(records, current_year, COLUMNS, cube)
    for name, df in found.items():
        writers.write_table(df.coalesce(1), f"{folder}/insights/{name}")
    return found


def forecast_stage(
    records: DataFrame, folder: str, as_of: str, horizon: int = 12, history_months: int = 60
) -> DataFrame:
    built = forecast.region_forecast(records, as_of, horizon, history_months, columns=COLUMNS)
    path = writers.write_table(built, f"{folder}/curated/monthly_forecast")
    stored = records.sparkSession.read.parquet(path)
    ahead = stored.where(F.col("recordType") == "Forecast")
    sample = sampling.head_per_group(ahead, "region", [F.col("month")], 12)
    writers.export_forecast(sample, f"{folder}/sample/monthly_forecast_sample", None)
    return stored


def serve_stage(
    stored: DataFrame, records: DataFrame, folder: str, as_of: str, horizon: int = 12
) -> DataFrame:
    """What is shown of every region: its stored forecast while that is usable, else a new one."""
    shown = serving.served_points(
        serving.serve_or_forecast(stored, records, as_of, horizon, 60, COLUMNS)
    )
    path = writers.write_table(shown.coalesce(1), f"{folder}/curated/served_forecast")
    return records.sparkSession.read.parquet(path)


def run(spark: SparkSession, raw_path: str, folder: str, as_of: str) -> dict[str, int]:
    """All stages; returns the row counts of the main tables."""
    raw = land_stage(spark, raw_path, folder)
    profile_stage(raw, folder)
    cleaned = clean_stage(raw, folder)
    tables, built = star_stage(cleaned, folder)
    analysis_stage(tables, built, folder)
    loaded = readers.Loaded(normalise.normalise(raw), f"Raw file: {raw_path}", False)
    records = dashboard_stage(loaded, folder)
    insight_stage(records, folder, as_date(as_of).year)
    tables["dashboard_dataset"] = records
    stored = tables["monthly_forecast"] = forecast_stage(records, folder, as_of)
    tables["served_forecast"] = serve_stage(stored, records, folder, as_of)
    sizes = profile.table_sizes(tables | {"cleaned": cleaned})
    return {row["metric"].removeprefix("rows:"): row["value"] for row in sizes.collect()}


if __name__ == "__main__":
    session = (
        SparkSession.builder.appName("declarium pipeline")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    print(run(session, *sys.argv[1:4]))
