"""Rounding and clamping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLITTER = 134217729.0  # 2**27 + 1


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(value, F.lit(high)))


def zero_if_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def exact_round(value: Column, digits: int) -> Column:
    """Half-even rounding of the double's exact binary value.

    ``bround`` rounds the shortest decimal text of a double, so 2.675 (really
    2.67499...) becomes 2.68. Here the double is split into two halves whose
    products with the scale are exact, which makes the comparison with the
    midpoint exact too: 2.675 becomes 2.67.
    """
    scale = float(10**digits)
    size = F.abs(value)
    below = F.floor(size * scale).cast("double")
    lifted = size * F.lit(_SPLITTER)
    head = lifted - (lifted - size)
    tail = size - head
    over_midpoint = (head * (2 * scale) - (below * 2 + 1)) + tail * (2 * scale)
    step_up = (over_midpoint > 0) | ((over_midpoint == 0) & (below % 2 == 1))
    rounded = (below + F.when(step_up, 1.0).otherwise(0.0)) / scale
    return F.when(value < 0, -rounded).otherwise(rounded)


def whole_round(value: Column) -> Column:
    """Half-even rounding to a whole number."""
    return F.rint(value).cast("int")


def half_up_round(value: Column) -> Column:
    """Rounding to a whole number with halves going up, as screens show it."""
    return F.floor(value + F.lit(0.5)).cast("int")
