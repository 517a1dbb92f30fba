"""Readers: published CSV files and written tables, local or in object storage."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from declarium.functions.text import csv_value
from declarium.operators.normalise import normalise
from declarium.schema import NORMALISED_COLUMNS, RAW_COLUMNS, YEAR_FOLDER
from declarium.sources.open_lines import Splits, look_through, read_records


@dataclass(frozen=True)
class Candidate:
    """A place the data may be found in; any path Spark reads, ``s3a://`` included."""

    path: str
    label: str
    is_sample: bool = False


@dataclass(frozen=True)
class Loaded:
    records: DataFrame
    source_label: str
    is_sample: bool

    def with_provenance(self) -> DataFrame:
        return self.records.withColumns(
            {"data_source": F.lit(self.source_label), "sample_mode": F.lit(self.is_sample)}
        )


def has_open_lines(spark: SparkSession, path: str) -> bool:
    """Whether a quoted field holds a line break: some line then has an odd number of quotes."""
    return look_through(spark, path).open_lines


def read_csv(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """A CSV file with a header, every field as text, missing-value spellings as NULL.

    The header names the columns, so files with fewer or other columns read too; types are
    never inferred. Quoted fields may hold line breaks: unless ``multi_line`` says that there are
    none, the quotes of the file's splits are counted first, in parallel, and files with such
    fields are read split by split all the same (see ``open_lines``). Only files where a quote
    stands within an unquoted field, or a quoted field never ends, are read by one task each.
    """
    splits = Splits() if multi_line is False else look_through(spark, path)
    whole = splits.open_lines and splits.irregular
    reader = spark.read.option("header", True).option("escape", '"').option("inferSchema", False)
    rows = reader.option("multiLine", splits.open_lines).csv(path)
    if splits.open_lines and not whole:
        # a break within the header may hide that lines end in CR LF
        names = [name.removesuffix("\r") for name in rows.columns]
        rows = read_records(spark, path, names, splits)
    return rows.select([csv_value(F.col(f"`{name}`")).alias(name) for name in rows.columns])


def read_raw(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """The published file; its known columns first, in their published order."""
    df = read_csv(spark, path, multi_line)
    known = [name for name in RAW_COLUMNS if name in df.columns]
    return df.select(known + [name for name in df.columns if name not in RAW_COLUMNS])


def read_forecast(spark: SparkSession, path: str) -> DataFrame:
    """A stored forecast table written as CSV, typed again; unreadable months are dropped."""
    df = read_csv(spark, path)
    types = {
        "month": "date",
        "declarationRecords": "bigint",
        "lowerEstimate": "bigint",
        "upperEstimate": "bigint",
        "incidentTypeSupport": "double",
        "validationMae": "double",
    }
    typed = {name: F.col(name).try_cast(t) for name, t in types.items() if name in df.columns}
    return df.withColumns(typed).where(F.col("month").isNotNull())


CSV_ENDINGS = (".csv", ".csv.gz")


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file, a folder of CSV files, or a Parquet table."""
    names = [path, *listing(spark, path)]
    return read_raw(spark, path) if any(map(is_csv, names)) else spark.read.parquet(path)


def is_csv(name: str) -> bool:
    return name.endswith(CSV_ENDINGS)


def listing(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, or that of the file; an error if there is no such path."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [found.getPath().getName() for found in files.listStatus(place)]


def load_best(
    spark: SparkSession,
    candidates: Iterable[Candidate],
    order: list[Column] | None = None,
) -> Loaded:
    """The first candidate that can be read and holds rows.

    List object storage before local files, full data before samples. Whatever is wrong with a
    candidate - missing, denied, corrupt, another format - the next one is tried; the error at
    the end names every reason. Normalising keeps a row of every table that has one, so rows are
    looked for before it. Tables with exactly the normalised columns' types are taken as they
    are.
    """
    tried = []
    for candidate in candidates:
        try:
            df = read_any(spark, candidate.path)
            if df.isEmpty():
                tried.append(f"{candidate.path} (empty)")
                continue
            records = df if is_normalised(df) else normalise(df, order)
        except Exception as error:  # any failure of a source: the next one may do
            reason = (str(error).strip().splitlines() or [""])[0][:200]
            tried.append(f"{candidate.path} ({type(error).__name__}: {reason})")
            continue
        return Loaded(records, candidate.label, candidate.is_sample)
    raise FileNotFoundError(f"No data set could be loaded from: {'; '.join(tried)}")


def is_normalised(df: DataFrame) -> bool:
    """Written by this library: the normalised columns, dates typed; by year or not."""
    columns = [name for name in df.columns if name != YEAR_FOLDER]
    return columns == [name for name in NORMALISED_COLUMNS if name in columns] and (
        isinstance(df.schema["declarationDate"].dataType, (T.TimestampNTZType, T.TimestampType))
        if "declarationDate" in df.columns
        else False
    )


def default_candidates(folder: str, object_store: str | None = None) -> list[Candidate]:
    """The usual places, best first: object store, dashboard, cleaned, raw, landed, samples."""
    found = [Candidate(object_store, f"Object store: {object_store}")] if object_store else []
    return found + [
        Candidate(f"{folder}/curated/dashboard_dataset", "Local dashboard dataset"),
        Candidate(f"{folder}/cleaned/declarations_cleaned", "Local cleaned dataset"),
        Candidate(f"{folder}/raw/declarations_raw.csv", "Local raw dataset"),
        Candidate(f"{folder}/landed/declarations.csv", "Landed copy of the published file"),
        Candidate(f"{folder}/sample/dashboard_dataset_sample", "Dashboard sample", True),
        Candidate(f"{folder}/sample/declarations_cleaned_sample", "Cleaned sample", True),
        Candidate(f"{folder}/sample/declarations_sample.csv", "Raw sample", True),
    ]
