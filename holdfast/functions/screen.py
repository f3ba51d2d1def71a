"""Expressions the screens compute over report rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from holdfast.functions import labels as L
from holdfast.functions.numbers import half_up_round
from holdfast.functions.rules import first_match


def attention_level(mean: Column, share: Column, high_risk: Column) -> Column:
    """Struct of label and tone for a segment."""

    def level(label: str, tone: str) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit(tone).alias("tone"))

    return first_match(
        [
            ((mean >= m) | (share >= s) | (high_risk >= n), level(label, tone))
            for m, s, n, label, tone in L.ATTENTION_LEVELS
        ],
        level(*L.ATTENTION_DEFAULT),
    )


def points_from(mean: Column, overall: Column) -> Column:
    """Distance to the overall mean in whole percentage points."""
    return half_up_round(F.abs(mean - overall) * 100)


def direction_from(mean: Column, overall: Column) -> Column:
    """``above`` or ``below`` the overall mean, ``level`` when it rounds to nothing."""
    return first_match(
        [(points_from(mean, overall) == 0, "level"), (mean > overall, "above")], "below"
    )


def share_tone(share: Column) -> Column:
    return first_match([(share >= 0.5, "red"), (share >= 0.15, "amber")], "green")


def probability_tone(probability: Column) -> Column:
    return first_match([(probability >= 0.7, "red"), (probability >= 0.35, "amber")], "green")
