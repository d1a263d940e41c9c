"""Numeric functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log(x: Column) -> Column:
    """Natural logarithm with minus infinity at zero."""
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(float("-inf")))


def digamma(x: Column) -> Column:
    """psi(x) for x > 0 (minus infinity at 0): recurrence to x + 10, then the asymptotic series."""
    x = x.cast("double")
    y = x + 10
    low = sum((1 / (x + k) for k in range(1, 10)), 1 / x)
    i = 1 / (y * y)
    series = F.ln(y) - 0.5 / y - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))
    return F.when(x > 0, series - low).otherwise(F.lit(float("-inf")))


def in_band(i: Column, j: Column, x1: Column, x2: Column) -> Column:
    """Whether (i, j) lies between the diagonals of an x1 by x2 rectangle."""
    d = x2 - x1
    return (j - i).between(F.least(d, F.lit(0)), F.greatest(d, F.lit(0)))
