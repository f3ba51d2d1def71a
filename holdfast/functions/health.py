"""Customer health card."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from holdfast.functions import labels as L
from holdfast.functions.numbers import clamp, exact_round, whole_round
from holdfast.functions.rules import first_match


def revenue_at_risk(probability: Column, charge: Column) -> Column:
    return exact_round(probability * charge, 2)


def health_score(probability: Column, group: Column, factor: Column, charge: Column) -> Column:
    """0 (worst) to 100."""
    group_points = first_match([(group == "High", F.lit(8)), (group == "Medium", F.lit(4))], F.lit(0))
    charge_points = first_match([(charge >= 90, F.lit(5)), (charge >= 75, F.lit(3))], F.lit(0))
    factor_points = F.when(factor != L.STABLE_FACTOR, 4).otherwise(0)
    score = F.lit(100) - probability * 70 - group_points - charge_points - factor_points
    return whole_round(clamp(score, 0.0, 100.0))


def health_status(score: Column) -> Column:
    """Struct of code, label and tone."""

    def state(code: str, label: str, tone: str) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit(label).alias("label"), F.lit(tone).alias("tone"))

    *graded, best = L.HEALTH_STATES
    return first_match([(score <= top, state(*names)) for top, *names in graded], state(*best[1:]))


def processing_priority(group: Column, priority: Column) -> Column:
    """1 to 3, by the priority label in either language, else by the risk group."""
    levels = ("High", "Medium", "Low")
    cases = [
        (priority.isin(name, L.PRIORITY_TEXT[name]), F.lit(place))
        for place, name in enumerate(levels, start=1)
    ]
    cases += [(group == "High", F.lit(1)), (group == "Medium", F.lit(2))]
    return first_match(cases, F.lit(3))


def reduction_potential(group: Column, action: Column) -> Column:
    return first_match(
        [(action == L.NO_ACTION, "Low"), (group.isin("High", "Medium"), group)], "Low"
    )


def _driver(code: str, label: Column, impact: str, number: Column | None = None) -> Column:
    no_text, no_number = F.lit(None).cast("string"), F.lit(None).cast("double")
    return F.struct(
        F.lit(code).alias("code"),
        (label if number is None else no_text).alias("value_text"),
        (no_number if number is None else number).alias("value_num"),
        label.alias("label"),
        F.lit(impact).alias("impact"),
    )


def risk_drivers(
    probability: Column, factor: Column, charge: Column, segment_name: Column, action: Column
) -> Column:
    """Up to five drivers, of which the first four stay."""
    found = [
        ((factor != "") & (factor != L.STABLE_FACTOR), _driver("main_risk_factor", factor, "high")),
        (
            probability >= 0.7,
            _driver("high_churn_probability", F.lit("High churn probability"), "high",
                    exact_round(probability, 2)),
        ),
        (
            charge >= 80,
            _driver("high_estimated_charge", F.lit("High estimated charge"), "medium",
                    exact_round(charge, 2)),
        ),
        (segment_name != "", _driver("segment", segment_name, "medium")),
        ((action != "") & (action != L.NO_ACTION), _driver("recommended_action", action, "medium")),
    ]
    return F.slice(F.array_compact(F.array(*[F.when(test, item) for test, item in found])), 1, 4)


def health_card(
    probability: Column,
    group: Column,
    factor: Column,
    charge: Column,
    segment_name: Column,
    action: Column,
    reason: Column,
    priority: Column,
) -> Column:
    """The nested card shown beside a customer."""
    score = health_score(probability, group, factor, charge)
    shown_action = F.when(action != "", action).otherwise(L.NO_ACTION)
    return F.struct(
        score.alias("score"),
        health_status(score).alias("status"),
        revenue_at_risk(probability, charge).alias("revenue_at_risk"),
        risk_drivers(probability, factor, charge, segment_name, action).alias("risk_drivers"),
        F.struct(
            shown_action.alias("recommendation_type"),
            reason.alias("recommendation_reason"),
            priority.alias("priority"),
        ).alias("next_best_action"),
        F.struct(
            reduction_potential(group, action).alias("risk_reduction_potential"),
            processing_priority(group, priority).alias("processing_priority"),
        ).alias("expected_effect"),
    )
