"""CSV files whose quoted fields hold line breaks, read by as many tasks as there are splits.

A line break ends a record only outside quotes, and whether it is outside depends on all quotes
before it. The number of quotes of every split tells it: a running parity over the splits of a file
says which ones begin within a record. Each split is then read from its first true record start;
the lines before it are joined to the record that an earlier split left open.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from declarium.operators.scale import fixed

# A line with an odd number of quotes either opens a field, at the line's start or behind a comma, or
# closes one, before a comma or the line's end. Any other one has a quote that stands for itself.
OPENS = r'(?:^|,)"[^"]*+(?:""[^"]*+)*+$'
CLOSES = r'^[^"]*+(?:""[^"]*+)*+"(?:,|\r?$)'


@dataclass
class Splits:
    """What the quotes of a file's splits say about them; two numbers a split that begins open."""

    open_lines: bool = False
    # some quote is no delimiter, or a field never ends: lines cannot be told apart by parity
    irregular: bool = False
    # of splits that begin within a record: the split it began in, and how many splits ago
    began: dict[int, tuple[int, int]] = field(default_factory=dict)


def pin_splits(spark: SparkSession) -> None:
    """Files are split alike in every scan of this session.

    By default the size of splits follows the cores there are, which come and go.
    """
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        cores = spark.sparkContext.defaultParallelism
        spark.conf.set("spark.sql.files.minPartitionNum", str(cores))


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, start, split): lines, where their split begins, and a number for it."""
    start = F.input_file_block_start()
    return spark.read.option("lineSep", "\n").text(path).select(
        "value",
        F.input_file_name().alias("file"),
        start.alias("start"),
        F.xxhash64(F.input_file_name(), start).alias("split"),
    )


def odd_quotes(line: Column) -> Column:
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    return quotes % 2 == 1


def look_through(spark: SparkSession, path: str) -> Splits:
    """Count the quotes of every split, without leaving the JVM; one small row a split comes back."""
    pin_splits(spark)
    line = F.col("value")
    stray = odd_quotes(line) & ~line.rlike(OPENS) & ~line.rlike(CLOSES)
    rows = (
        split_lines(spark, path)
        .groupBy("file", "start", "split")
        .agg(F.count_if(odd_quotes(line)).alias("odd"), F.count_if(stray).alias("stray"))
        .collect()
    )
    found = Splits(open_lines=any(row.odd for row in rows))
    found.irregular = any(row.stray for row in rows) or len({row.split for row in rows}) < len(rows)
    file, is_open, owner, ago = None, False, 0, 0
    for row in sorted(rows, key=lambda row: (row.file, row.start)):
        if row.file != file:
            found.irregular |= is_open
            file, is_open = row.file, False
        if is_open:
            ago += 1
            found.began[row.split] = (owner, ago)
        if row.odd:
            is_open ^= bool(row.odd % 2)
            owner, ago = row.split, 0
    found.irregular |= is_open
    return found


def record_pieces(spark: SparkSession, path: str, splits: Splits) -> DataFrame:
    """(text, split, nth): whole records, and pieces of those that several splits hold.

    ``split`` is null for whole records; for pieces it is the split that the record began in, and
    ``nth`` puts them in order. The first record of a file, its header, is left out.
    """
    began = spark.sparkContext.broadcast(splits.began)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc

        now, held, first, header = None, [], None, False

        def rows(texts, split=None, nth=None) -> pa.RecordBatch:
            count = len(texts)
            return pa.RecordBatch.from_arrays(
                [
                    texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()),
                    pa.array([split] * count, pa.int64()),
                    pa.array([nth] * count, pa.int32()),
                ],
                names=["text", "split", "nth"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for low, high in zip(cuts, cuts[1:]):
                lines = batch.column(0).slice(low, high - low)
                if numbers[low] != now:
                    if held:  # what the last split leaves open
                        yield rows(["\n".join(held)], *(first or (now, 0)))
                    now, held = int(numbers[low]), []
                    first = began.value.get(now)  # the piece that the split begins with
                    is_open = first is not None
                    header = batch.column(2)[low].as_py()
                odd = pc.count_substring(lines, '"').to_numpy() % 2 == 1
                inside = (np.cumsum(odd) - odd + is_open) % 2 == 1
                whole = ~inside & ~odd
                broken, closed = np.flatnonzero(~whole), []
                for i, text in zip(broken.tolist(), lines.take(pa.array(broken)).to_pylist()):
                    held.append(text)
                    if inside[i] and odd[i]:
                        text, held = "\n".join(held), []
                        if first is not None:
                            yield rows([text], *first)
                            first = None
                        else:
                            closed.append((i, text))
                is_open = bool(inside[-1]) != bool(odd[-1])
                places = np.flatnonzero(whole)
                texts = lines.take(pa.array(places))
                if closed:  # records in the order of their last lines
                    texts = pa.concat_arrays([texts, pa.array([t for _, t in closed], texts.type)])
                    places = np.concatenate([places, [i for i, _ in closed]])
                    texts = texts.take(pa.array(np.argsort(places)))
                if header and len(texts):
                    texts, header = texts.slice(1), False
                if len(texts):
                    yield rows(texts)
        if held:
            yield rows(["\n".join(held)], *(first or (now, 0)))

    lines = split_lines(spark, path).select("value", "split", (F.col("start") == 0).alias("top"))
    return lines.mapInArrow(pieces, "text string, split long, nth int")


def read_records(spark: SparkSession, path: str, names: list[str], splits: Splits) -> DataFrame:
    """The records of files with line breaks in fields, all fields as text.

    The pieces are fixed once in the shared checkpoint folder: whole records and broken ones are
    read from there, not the file twice. Only pieces of records are shuffled.
    """
    landed = fixed(record_pieces(spark, path, splits))
    broken = landed.where("split is not null").groupBy("split")
    joined = broken.agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda p: p["text"]), "\n"
        ).alias("text")
    )
    records = landed.where("split is null").select("text").union(joined.select("text"))
    text = F.regexp_replace("text", "\r$", "")
    schema = ", ".join(f"`{name.replace('`', '``')}` string" for name in names)
    parsed = records.where(F.length(F.trim(text)) > 0).select(
        F.from_csv(text, F.lit(schema), {"escape": '"', "mode": "PERMISSIVE"}).alias("fields")
    )
    return parsed.select("fields.*")
