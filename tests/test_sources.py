import csv
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from declarium.operators import forecast, normalise
from declarium.plans import pipeline
from declarium.plans.tables import raw_records
from declarium.schema import FORECAST_EXPORT_COLUMNS, RAW_COLUMNS
from declarium.sources import readers, writers

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def raw_file(spark, tmp_path_factory):
    """A published-style CSV of the order tables."""
    path = tmp_path_factory.mktemp("raw") / "raw" / "declarations_raw.csv"
    path.parent.mkdir()
    rows = raw_records(spark, SF).collect()
    with path.open("w", newline="", encoding="utf-8") as file:
        writer = csv.writer(file)
        writer.writerow(RAW_COLUMNS)
        for row in rows:
            fields = row.asDict()
            writer.writerow([fields.get(name) or "" for name in RAW_COLUMNS])
    return path


def test_csv_null_tokens_quotes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,title,n\n1,"a ""b"", c",NA\n2,"two\nlines",null\n3,,7\n', encoding="utf-8")
    rows = [tuple(r) for r in readers.read_csv(spark, str(path), multi_line=True).collect()]
    assert rows == [("1", 'a "b", c', None), ("2", "two\nlines", None), ("3", None, "7")]


def test_raw_columns_come_in_published_order(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("extra,id,state\nx,1,TX\n")
    assert readers.read_raw(spark, str(path)).columns == ["state", "id", "extra"]


def test_best_source(spark, raw_file, tmp_path):
    folder = tmp_path / "data"
    (folder / "sample").mkdir(parents=True)
    sample = folder / "sample" / "declarations_sample.csv"
    sample.write_text("id,state,declarationDate\n1,tx,2020-01-01\n")
    loaded = readers.load_best(spark, readers.default_candidates(str(folder)))
    assert loaded.is_sample and loaded.source_label == "Raw sample"
    row = loaded.with_provenance().first()
    assert (row.state, row.sample_mode, row.data_source) == ("TX", True, "Raw sample")

    # A sample leaves an empty full table, which is skipped as a source.
    curated = str(folder / "curated" / "dashboard_dataset")
    writers.write_table(loaded.records, curated)
    assert writers.write_full(loaded.records, curated, loaded.is_sample) is None
    assert spark.read.parquet(curated).isEmpty()
    assert readers.load_best(spark, readers.default_candidates(str(folder))).is_sample

    (folder / "raw").mkdir()
    (folder / "raw" / "declarations_raw.csv").write_bytes(raw_file.read_bytes())
    loaded = readers.load_best(spark, readers.default_candidates(str(folder)))
    assert (loaded.source_label, loaded.is_sample) == ("Local raw dataset", False)
    assert loaded.records.count() == 1500

    writers.write_full(loaded.records, curated, loaded.is_sample)
    store = str(tmp_path / "store")
    writers.write_table(loaded.records.limit(3), store)
    loaded = readers.load_best(spark, readers.default_candidates(str(folder)))
    assert loaded.source_label == "Local dashboard dataset"
    loaded = readers.load_best(spark, readers.default_candidates(str(folder), store))
    assert loaded.source_label == f"Object store: {store}" and loaded.records.count() == 3
    with pytest.raises(FileNotFoundError):
        readers.load_best(spark, readers.default_candidates(str(tmp_path / "nothing")))


def test_records_by_year_skip_folders(spark, tmp_path):
    records = normalise.normalise(raw_records(spark, SF))
    path = writers.write_records(records, str(tmp_path / "t"))
    back = spark.read.parquet(path)
    assert back.count() == records.count()
    plan = back.where("year = 1999")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    assert all(p.name.startswith("year=") for p in Path(path).iterdir() if p.is_dir())


def test_pipeline(spark, raw_file, tmp_path):
    folder = str(tmp_path / "out")
    sizes = pipeline.run(spark, str(raw_file), folder, "2001-08-15")
    assert sizes["cleaned"] == sizes["fact_declarations"] == sizes["dashboard_dataset"] == 1500

    def sample(name):
        return readers.read_csv(spark, f"{folder}/sample/{name}")

    regions = sample("analysis_declarations_by_region").collect()
    assert sum(int(r.declarationCount) for r in regions) == 1500
    years = sample("analysis_declarations_by_year")
    dated = spark.read.parquet(f"{folder}/curated/dashboard_dataset").where(
        "declarationDate IS NOT NULL").count()
    assert years.agg(F.sum(F.col("declarationCount").cast("int"))).first()[0] == dated
    assert sample("analysis_top_state_incident_mix").count() == 25
    assert sample("profile_missing").first().column == "declarationRequestNumber"
    assert spark.read.parquet(f"{folder}/sample/dashboard_dataset_sample").count() == 1000
    assert {p.name for p in Path(folder, "insights").iterdir()} == {
        "top_month", "top_season", "top_states", "top_incident_types", "top_regions",
        "long_term_trend", "historical_spikes", "records_vs_disasters"}

    stored = readers.read_forecast(spark, f"{folder}/sample/monthly_forecast_sample")
    assert stored.count() == 12 * stored.select("region").distinct().count() > 0
    assert dict(stored.dtypes)["month"] == "date" and stored.first().month == date(2001, 9, 1)


def test_forecast_and_listing_exports(spark, tmp_path):
    records = normalise.normalise(raw_records(spark, SF))
    built = forecast.region_forecast(records, "2001-08-15", 6, 12)
    path = writers.export_forecast(built, str(tmp_path / "f"))
    back = readers.read_csv(spark, path)
    assert back.columns == FORECAST_EXPORT_COLUMNS
    assert back.count() == built.count() and back.first().month.endswith("-01")
    listed = readers.read_csv(spark, writers.export_listing(records, str(tmp_path / "l")))
    assert len(listed.columns) == 8 and listed.count() == 1500
    assert "Not Reported" in {r.femaRegion for r in listed.select("femaRegion").distinct().collect()}


def test_unreadable_months_are_dropped(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text("region,month,declarationRecords\nRegion 1,2020-01-01,3\nRegion 1,bad,4\n")
    rows = readers.read_forecast(spark, str(path)).collect()
    assert [tuple(r) for r in rows] == [("Region 1", date(2020, 1, 1), 3)]


RAW_LINES = (
    "id,declarationDate,state,declarationTitle,declarationType\n"
    '1,2020-01-02T00:00:00.000Z,TX,"TWO\nLINES",DR\n'
    "2,2020-01-03T00:00:00.000Z,TX,PLAIN,DR\n"
)


def test_line_breaks_in_fields_by_default(spark, tmp_path):
    path = tmp_path / "raw" / "declarations_raw.csv"
    path.parent.mkdir()
    path.write_text(RAW_LINES)
    assert [r.id for r in readers.read_raw(spark, str(path)).collect()] == ["1", "2"]
    loaded = readers.load_best(spark, readers.default_candidates(str(tmp_path)))
    assert sorted(r.id for r in loaded.records.collect()) == ["1", "2"]
    assert readers.has_open_lines(spark, str(path))


def test_failing_sources_are_passed_over(spark, tmp_path):
    broken = tmp_path / "curated" / "dashboard_dataset"
    broken.mkdir(parents=True)
    (broken / "part-0.parquet").write_text("this is no table")
    landed = tmp_path / "landed" / "declarations.csv"
    landed.parent.mkdir()
    landed.write_text(RAW_LINES)
    candidates = readers.default_candidates(str(tmp_path), "nosuchstore://bucket/x")
    loaded = readers.load_best(spark, candidates)
    assert loaded.source_label == "Landed copy of the published file"
    assert loaded.records.count() == 2
    with pytest.raises(FileNotFoundError, match="nosuchstore.*dashboard_dataset"):
        readers.load_best(spark, candidates[:2])


def test_samples_of_the_pipeline_are_read_as_csv(spark, tmp_path):
    folder = tmp_path / "sample" / "declarations_cleaned_sample"
    folder.mkdir(parents=True)
    (folder / "part-00000.csv").write_text(RAW_LINES)
    loaded = readers.load_best(spark, readers.default_candidates(str(tmp_path)))
    assert loaded.source_label == "Cleaned sample" and loaded.records.count() == 2


def test_date_filters_skip_folders(spark, tmp_path):
    from declarium.operators.filters import apply_filters

    raw = tmp_path / "raw.csv"
    raw.write_text(RAW_LINES.replace("2,2020", "2,2021"))
    records = normalise.normalise(readers.read_raw(spark, str(raw)))
    path = writers.write_records(records, str(tmp_path / "by_year"))
    stored = spark.read.parquet(path)
    assert readers.is_normalised(stored)
    chosen = apply_filters(stored, start="2021-01-01")
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    assert [r.id for r in chosen.collect()] == ["2"]
