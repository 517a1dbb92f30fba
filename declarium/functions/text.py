"""Text clean-up, labels and sentences as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from declarium.schema import (
    CSV_NULL_TOKENS,
    NOT_REPORTED,
    NULL_TOKENS,
    REGION_AREAS,
    REGION_NAMES,
)

# Every character that counts as white space at the ends of a text, by code point.
WHITESPACE = "".join(
    map(chr, [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203),
              8232, 8233, 8239, 8287, 12288])
)
# A code point that Unicode keeps out of all texts, and the blank that starts a word.
MARK = "\ufdd0 "
CASED = r"\p{IsLowercase}\p{IsUppercase}\p{Lt}"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.trim(text, F.lit(WHITESPACE))


def known(text: Column) -> Column:
    """NULL for the usual spellings of "missing"."""
    return F.when(~text.isin(NULL_TOKENS), text)


def clean_text(text: Column) -> Column:
    return known(strip(text))


def clean_texts(df: DataFrame, names: list[str]) -> DataFrame:
    """``clean_text`` on several columns in two steps.

    An expression used twice is worked out twice; a column of an earlier step is not.
    """
    stripped = df.withColumns({name: strip(F.col(name)) for name in names})
    return stripped.withColumns({name: known(F.col(name)) for name in names})


def csv_value(text: Column) -> Column:
    """A CSV field, NULL where it holds one of the missing-value spellings."""
    return F.when(~text.isin(CSV_NULL_TOKENS), text)


def title_case(text: Column) -> Column:
    """Capital after anything that is not a letter: ``Mud/Landslide``, ``Straight-Line``.

    ``initcap`` only starts a word after a blank. A mark that ends in a blank is put between
    any other sign and the letter after it, and taken out again: three passes over the text.
    """
    starts = F.lit(f"([^{CASED} ])(?=[{CASED}])")
    marked = F.regexp_replace(text, starts, F.lit(f"$1{MARK}"))
    return F.replace(F.initcap(marked), F.lit(MARK), F.lit(""))


def or_not_reported(text: Column) -> Column:
    return F.coalesce(text, F.lit(NOT_REPORTED))


def lookup(key: Column, table: dict[str, str]) -> Column:
    """The entry of a small literal table, NULL where the key is not in it."""
    entries = [F.lit(part) for pair in table.items() for part in pair]
    return F.create_map(*entries)[key]


def code_label(code: Column, labels: dict[str, str]) -> Column:
    return or_not_reported(F.coalesce(lookup(code, labels), code))


def region_label(number: Column) -> Column:
    return or_not_reported(F.concat(F.lit("Region "), number.cast("string")))


def region_order(label: Column) -> Column:
    """Sort key of a region label: its number; labels without one come last."""
    digits = F.regexp_extract(label, r"^Region (\d+)$", 1)
    return F.coalesce(digits.try_cast("int"), F.lit(999))


def region_description(label: Column, compact: bool = False) -> Column:
    """``Region 1 — New England (CT, …)``; compact leaves out the areas."""
    name = lookup(label, REGION_NAMES)
    described = F.concat(label, F.lit(" — "), name)
    if not compact:
        areas = lookup(label, REGION_AREAS)
        described = F.concat(described, F.lit(" ("), areas, F.lit(")"))
    return F.coalesce(described, label)
