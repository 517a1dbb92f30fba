"""CSV files with line breaks in quoted fields, against reading them whole."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from declarium.sources import open_lines, readers


@pytest.fixture
def small_splits(spark):
    """Splits of a few hundred bytes, so that records lie across several."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {name: spark.conf.get(name) for name in names}
    for name, value in zip(names, ("700b", "0b")):
        spark.conf.set(name, value)
    yield
    for name, value in old.items():
        spark.conf.set(name, value)


def write(path, rows, end="\r\n", header=("id", "title", "note")):
    with path.open("w", newline="", encoding="utf-8") as file:
        writer = csv.writer(file, lineterminator=end)
        writer.writerow(header)
        writer.writerows(rows)


def read_whole(spark, path):
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(path))


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


@pytest.mark.parametrize("share", [0.0, 0.02, 0.4, 1.0])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equal_rows_at_any_share_of_broken_lines(spark, tmp_path, small_splits, share, end):
    chance = random.Random(int(share * 100))
    fields = ['say ""', 'a,b', "", "é ü", 'quote " in', '"', "x" * 90]
    rows = []
    for i in range(300):
        breaks = chance.randint(1, 30) if chance.random() < share else 0
        parts = [chance.choice(fields) for _ in range(breaks + 1)]
        rows.append((i, "\n".join(parts), chance.choice(fields)))
    path = tmp_path / "a.csv"
    write(path, rows, end)
    same(readers.read_csv(spark, str(path)), readers.read_csv(spark, str(path), multi_line=None))
    whole = read_whole(spark, path)
    cleaned = whole.select([readers.csv_value(F.col(c)).alias(c) for c in whole.columns])
    same(readers.read_csv(spark, str(path)), cleaned)
    splits = open_lines.look_through(spark, str(path))
    assert not splits.irregular and splits.open_lines == (share > 0)
    if share == 1.0:
        assert len(splits.began) > 3


def test_one_line_break_does_not_cost_the_splits(spark, tmp_path, small_splits):
    """As many tasks as a plain file, and no task that reads the file whole."""
    rows = [(i, f"title {i}", "plain") for i in range(2000)]
    plain, broken = tmp_path / "plain.csv", tmp_path / "broken.csv"
    write(plain, rows)
    rows[1000] = (1000, "two\nlines", "plain")
    write(broken, rows)
    tasks = spark.read.text(str(plain)).rdd.getNumPartitions()
    splits = open_lines.look_through(spark, str(broken))
    pieces = open_lines.record_pieces(spark, str(broken), splits)
    assert pieces.rdd.getNumPartitions() >= tasks > 50
    found = {r.id: r.title for r in readers.read_csv(spark, str(broken)).collect()}
    assert len(found) == 2000 and found["1000"] == "two\nlines" and found["1999"] == "title 1999"


def test_records_over_many_batches(spark, tmp_path):
    """More lines than a batch holds; records that end with a batch, or lie across two."""
    rows = [(i, f"two\nlines {i}" if i % 3 else f"{i}", "a\nb\n\nc" if i % 7 == 0 else "x") for i in range(30_000)]
    path = tmp_path / "a.csv"
    write(path, rows, "\n")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("10000", "97"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        found = [tuple(r) for r in readers.read_csv(spark, str(path)).collect()]
        assert sorted(found) == sorted((str(a), b, c) for a, b, c in rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_a_field_over_many_splits(spark, tmp_path, small_splits):
    rows = [(1, "\n".join(f"line {i}" for i in range(3000)), "x"), (2, "plain", 'a\n"b"\nc')]
    path = tmp_path / "a.csv"
    write(path, rows)
    found = {r.id: (r.title, r.note) for r in readers.read_csv(spark, str(path)).collect()}
    assert found == {"1": rows[0][1:], "2": rows[1][1:]}


def test_a_folder_of_files_and_a_broken_header(spark, tmp_path, small_splits):
    folder = tmp_path / "files"
    folder.mkdir()
    header = ("id", "two\nlines", "note")
    for i in range(4):
        write(folder / f"{i}.csv", [(i, "a\nb", j) for j in range(60)], header=header)
    found = readers.read_csv(spark, str(folder))
    assert found.columns == list(header) and found.count() == 240
    assert {r[1] for r in found.collect()} == {"a\nb"}


def test_quotes_that_stand_for_themselves(spark, tmp_path):
    """Such files, and those with a field that never ends, are read whole."""
    path = tmp_path / "a.csv"
    path.write_text('id,title\n1,5" pipe\n2,"two\nlines"\n3,x\n')
    assert open_lines.look_through(spark, str(path)).irregular
    found = [tuple(r) for r in readers.read_csv(spark, str(path)).collect()]
    assert found == [("1", '5" pipe'), ("2", "two\nlines"), ("3", "x")]
    path.write_text('id,title\n1,a\n2,"never ends\n3,x\n')
    assert open_lines.look_through(spark, str(path)).irregular
    same(readers.read_csv(spark, str(path)), read_whole(spark, path))


def test_short_and_long_rows_and_blank_lines(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,title,note\n1\n\n2,"a\nb",c,d\n   \n3,,\n4,"",NA\n')
    found = [tuple(r) for r in readers.read_csv(spark, str(path)).collect()]
    assert sorted(found) == [("1", None, None), ("2", "a\nb", "c"), ("3", None, None), ("4", None, None)]


def test_an_empty_and_a_bare_file(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("id,title\n")
    assert readers.read_csv(spark, str(path)).isEmpty()
    path.write_text('"id","two\nlines"\n')
    found = readers.read_csv(spark, str(path))
    assert found.columns == ["id", "two\nlines"] and found.isEmpty()
