"""Repeatable pseudo-random draws.

A draw is a function of the seed, the row's number and the draw's name, taken
from an MD5 digest. Unlike ``rand(seed)`` it does not depend on how the rows are
partitioned, so a retried or re-planned task makes the same rows again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAWS_PER_DIGEST = 4


def _hex_value(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("bigint")


def digest(seed: int, number: Column, block: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), number.cast("string"), F.lit(f":{block}")).cast("binary"))


def pick(seed: int, number: Column, count: int) -> Column:
    """A position in 0 .. count-1, from 52 random bits."""
    bits = _hex_value(F.substring(digest(seed, number, "pick"), 1, 13))
    return F.floor(bits / F.lit(float(2**52)) * F.lit(float(count)))


def uniform(digest_column: Column, slot: int) -> Column:
    """One of the four draws in [0, 1) that a digest holds."""
    return _hex_value(F.substring(digest_column, 1 + 8 * slot, 8)) / F.lit(float(2**32))


def spread(value: Column, ratio: float, draw: Column) -> Column:
    """``value`` scaled by a factor between 1 - ratio and 1 + ratio."""
    low, high = 1 - ratio, 1 + ratio
    return value * (F.lit(low) + F.lit(high - low) * draw)


def step(value: Column, delta: int, draw: Column) -> Column:
    """``value`` moved by a whole number between -delta and +delta."""
    return value + F.floor(draw * (2 * delta + 1)).cast("int") - delta
