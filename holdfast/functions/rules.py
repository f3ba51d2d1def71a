"""Business rules as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from holdfast.functions import labels as L
from holdfast.functions.numbers import zero_if_null

_BLANKS = " \t\n\r\x0b\x0c"


def first_match(cases: Iterable[tuple[Column, Column | str]], otherwise) -> Column:
    """The value of the first case that holds."""
    chain = None
    for test, value in cases:
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return chain.otherwise(otherwise)


def lookup(value: Column, entries: dict[str, str], otherwise) -> Column:
    """The entry whose key equals ``value``."""
    return first_match(((value == key, text) for key, text in entries.items()), otherwise)


def yes_no_text(value: Column) -> Column:
    """Lower-case plan text with true/1 as yes, false/0 as no and NULL as none."""
    text = F.coalesce(F.lower(value), F.lit("none"))
    return first_match(
        [(text.isin("true", "1"), "yes"), (text.isin("false", "0"), "no")], text
    )


def says_yes(value: Column, trim: str = "blanks") -> Column:
    """Whether plan text means yes. ``trim``: ``none``, ``spaces`` or ``blanks``."""
    return F.lower(trimmed(value, trim)).isin(*L.YES_WORDS)


def says_no(value: Column, trim: str = "none") -> Column:
    return F.lower(trimmed(value, trim)).isin(*L.NO_WORDS)


def trimmed(value: Column, trim: str = "blanks") -> Column:
    if trim == "none":
        return value
    return F.trim(value) if trim == "spaces" else F.trim(value, F.lit(_BLANKS))


def total_charge(day: Column, evening: Column, night: Column, international: Column) -> Column:
    return zero_if_null(day) + zero_if_null(evening) + zero_if_null(night) + zero_if_null(international)


def risk_group(probability: Column) -> Column:
    return first_match(
        [(probability >= L.HIGH_RISK, "High"), (probability >= L.MEDIUM_RISK, "Medium")], "Low"
    )


def main_risk_factor(
    calls: Column, day_charge: Column, international: Column, voice_mail: Column, trim: str = "none"
) -> Column:
    """Scoring compares plan text as it is; reconciliation trims spaces first."""
    return first_match(
        [
            (calls >= 3, L.CALLS_FACTOR),
            (day_charge >= 40, L.DAY_FACTOR),
            (says_yes(international, trim), L.INTL_FACTOR),
            (says_no(voice_mail, trim), L.VOICE_FACTOR),
        ],
        L.STABLE_FACTOR,
    )


def segment(
    calls: Column,
    day_minutes: Column,
    day_charge: Column,
    total: Column,
    international: Column,
    intl_minutes: Column,
    intl_charge: Column,
    trim: str = "blanks",
) -> Column:
    """Struct of ``segment_id`` and ``segment_name``."""

    def labelled(number: int, name: str) -> Column:
        return F.struct(F.lit(number).alias("segment_id"), F.lit(name).alias("segment_name"))

    heavy_day = (day_minutes >= 230) | (day_charge >= 40) | (total >= 65)
    abroad = says_yes(international, trim) | (intl_minutes >= 10) | (intl_charge >= 3)
    return first_match(
        [
            (calls >= 3, labelled(1, L.SERVICE_SEGMENT)),
            (heavy_day, labelled(2, L.TARIFF_SEGMENT)),
            (abroad, labelled(3, L.INTL_SEGMENT)),
        ],
        labelled(4, L.STABLE_SEGMENT),
    )


def priority(probability: Column, charge: Column) -> Column:
    chance = zero_if_null(probability)
    at_risk = chance * zero_if_null(charge)
    return first_match(
        [
            ((chance >= L.HIGH_RISK) | (at_risk >= L.HIGH_REVENUE_AT_RISK), "High"),
            ((chance >= L.MEDIUM_RISK) | (at_risk >= L.MEDIUM_REVENUE_AT_RISK), "Medium"),
        ],
        "Low",
    )


def recommendation(factor: Column, probability: Column, charge: Column, low: Column | None = None) -> Column:
    """Struct of type, reason and priority.

    ``low`` marks customers who need no action. Scoring takes it from the
    probability (the default), reconciliation from the stored risk group.
    """
    if low is None:
        low = zero_if_null(probability) < L.MEDIUM_RISK
    kind = F.when(low, L.NO_ACTION).otherwise(lookup(factor, L.FACTOR_ACTION, L.DISCOUNT))
    return F.struct(
        kind.alias("recommendation_type"),
        lookup(kind, L.REASONS, None).alias("recommendation_reason"),
        F.when(low, "Low").otherwise(priority(probability, charge)).alias("priority"),
    )


def segment_factor(segment_name: Column, action: Column, top_factor: Column) -> Column:
    """The factor a segment stands for, else its action's, else its most frequent one."""
    by_action = lookup(action, L.ACTION_FACTOR, F.coalesce(top_factor, F.lit(L.STABLE_FACTOR)))
    return lookup(segment_name, L.SEGMENT_FACTOR, by_action)


def factor_rank(factor: Column) -> Column:
    """Tie-break order of factors."""
    return first_match(
        [(factor == name, F.lit(place)) for place, name in enumerate(L.FACTOR_ORDER, start=1)],
        F.lit(len(L.FACTOR_ORDER) + 1),
    )


def risk_rank(group: Column) -> Column:
    return first_match(
        [(group == name, F.lit(place)) for place, name in enumerate(("High", "Medium", "Low"), 1)],
        F.lit(4),
    )


def impact(share: Column) -> Column:
    return first_match([(share >= 0.25, "High"), (share >= 0.05, "Medium")], "Low")
