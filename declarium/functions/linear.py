"""Solving a small linear system held in one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def solve(matrix: str, right_side: str) -> Column:
    """Solve ``matrix · x = right_side`` by elimination, for positive definite matrices.

    Both are SQL expressions, the matrix an array of rows. The solution stays a column
    expression, so fitting many groups needs no Python worker; positive definite systems
    need no row exchange. Step k scales row k and clears column k in every other row.
    """
    scaled = "transform(rows[k], v -> v / rows[k][k])"
    cleared = f"zip_with(row, {scaled}, (x, p) -> x - row[k] * p)"
    return F.expr(
        f"""aggregate(
            sequence(0, size({right_side}) - 1),
            zip_with({matrix}, {right_side}, (row, value) -> concat(row, array(value))),
            (rows, k) -> transform(rows, (row, i) -> if(i = k, {scaled}, {cleared})),
            rows -> transform(rows, row -> element_at(row, -1)))"""
    )


def dot(features: list[str], coefficients: str) -> str:
    return " + ".join(f"{coefficients}[{i}] * {feature}" for i, feature in enumerate(features))
