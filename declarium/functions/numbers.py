"""Number clean-up, rounding, decay and the seasonal features as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from declarium.schema import HARMONICS, SEASON_MONTHS

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def whole_number(text: Column) -> Column:
    """Text such as ``4`` or ``4.0`` to an integer; anything else, ``4.5`` too, is NULL."""
    number = F.when(text.cast("string").rlike(NUMBER), text.try_cast("double"))
    return F.when(number == F.floor(number), number.try_cast("int"))


def half_even(value: Column, digits: int = 0) -> Column:
    """Round half to even, as the figures of this data are published."""
    return F.rint(value) if digits == 0 else F.bround(value, digits)


def decay(age: Column, half_life: float) -> Column:
    """Weight that halves every ``half_life`` months."""
    return F.pow(F.lit(0.5), F.greatest(age, F.lit(0)) / F.lit(half_life))


def seasonal_features(offset: str, month_number: str) -> list[str]:
    """Intercept, trend in years, and sine and cosine of the first harmonics, as SQL."""
    features = ["1D", f"({offset}) / 12D"]
    for harmonic in range(1, HARMONICS + 1):
        angle = f"2D * pi() * {harmonic} * ({month_number} - 1) / {SEASON_MONTHS}"
        features += [f"sin({angle})", f"cos({angle})"]
    return features
