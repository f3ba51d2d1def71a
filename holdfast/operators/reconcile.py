"""Bring result tables back in line with the rules.

Each function returns its whole table with a ``changed`` flag; rows without a
counterpart stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions import rules
from holdfast.operators import quality
from holdfast.sources.buckets import buckets_for, saved_by_customer
from holdfast.sources.results import ResultStore


def _updated(rows: DataFrame, columns: list[str], expected: dict[str, Column]) -> DataFrame:
    """Replace differing values in rows that have a counterpart (``matched``)."""
    staged = rows.withColumns({f"__{name}": value for name, value in expected.items()})
    differs = F.lit(False)
    for name in expected:
        differs = differs | ~F.col(name).eqNullSafe(F.col(f"__{name}"))
    flagged = staged.withColumn("changed", F.coalesce(F.col("matched"), F.lit(False)) & differs)
    return flagged.select(
        *[
            F.when(F.col("changed"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in expected else c
            for c in columns
        ],
        "changed",
    )


def reconcile_factors(predictions: DataFrame, customers: DataFrame) -> DataFrame:
    """Recompute main risk factors from the customer table."""
    inputs = customers.select(
        "customer_id", "customer_service_calls", "total_day_charge", "international_plan",
        "voice_mail_plan", F.lit(True).alias("matched"),
    )
    factor = rules.main_risk_factor(
        F.col("customer_service_calls"), F.col("total_day_charge"), F.col("international_plan"),
        F.col("voice_mail_plan"), trim="spaces",
    )
    joined = predictions.join(inputs, "customer_id", "left")
    return _updated(joined, predictions.columns, {"main_risk_factor": factor})


def reconcile_recommendations(recommendations: DataFrame, predictions: DataFrame) -> DataFrame:
    """Recompute type, reason and priority from the predictions."""
    inputs = predictions.select(
        "customer_id", "risk_group", "main_risk_factor", "churn_probability",
        "estimated_total_charge", F.lit(True).alias("matched"),
    )
    advice = rules.recommendation(
        F.col("main_risk_factor"), F.col("churn_probability"), F.col("estimated_total_charge"),
        low=F.col("risk_group") == "Low",
    )
    names = ("recommendation_type", "recommendation_reason", "priority")
    joined = recommendations.join(inputs, "customer_id", "left").withColumn("advice", advice)
    return _updated(joined, recommendations.columns, {n: F.col(f"advice.{n}") for n in names})


def reconcile_segments(
    segments: DataFrame, predictions: DataFrame, customers: DataFrame
) -> DataFrame:
    """Recompute segments from the customer table and the stored charge."""
    inputs = predictions.select("customer_id", "estimated_total_charge").join(
        customers.select("customer_id", *quality.SEGMENT_INPUTS), "customer_id"
    )
    joined = segments.join(
        inputs.withColumn("matched", F.lit(True)), "customer_id", "left"
    ).withColumn("expected", quality.expected_segment())
    names = ("segment_id", "segment_name")
    return _updated(joined, segments.columns, {n: F.col(f"expected.{n}") for n in names})


@dataclass(frozen=True)
class Reconciled:
    """The corrected tables and a one-row report; tables are None after a check."""

    report: DataFrame
    predictions: DataFrame | None = None
    segments: DataFrame | None = None
    recommendations: DataFrame | None = None


def consistency(predictions, segments, recommendations, customers, suffix: str) -> DataFrame:
    """One row with the numbers of contradicting recommendations and drifted segments."""
    advice = quality.counted(
        quality.contradicting(predictions, recommendations), f"recommendations_{suffix}"
    )
    drift = quality.drifted_segments(segments, predictions, customers)
    return advice.withColumn(
        f"segments_{suffix}", quality.counted(drift, f"segments_{suffix}").scalar()
    )


def reconcile(
    predictions: DataFrame,
    segments: DataFrame,
    recommendations: DataFrame,
    customers: DataFrame,
    check_only: bool = False,
    buckets: int | None = None,
    save: Callable[[str, DataFrame], DataFrame] | None = None,
) -> Reconciled:
    """Count, correct factors, then recommendations, then segments, and count again.

    The corrected tables are written once each, by ``save`` (see ``reconcile_results``) or to
    scratch: later steps and the report read the files instead of repeating the joins.
    """
    before = consistency(predictions, segments, recommendations, customers, "before")
    if check_only:
        return Reconciled(before)
    if save is None:
        count = buckets or buckets_for(customers.count())

        def save(table: str, rows: DataFrame) -> DataFrame:
            return saved_by_customer(rows, count)

    new_p = save("predictions", reconcile_factors(predictions, customers).drop("changed"))
    new_r = save("customer_recommendations", reconcile_recommendations(recommendations, new_p).drop("changed"))
    new_s = save("customer_segments", reconcile_segments(segments, new_p, customers).drop("changed"))
    after = consistency(new_p, new_s, new_r, customers, "after")
    advice = ("recommendation_type", "recommendation_reason", "priority")
    report = before.withColumns(
        {
            "updated_risk_factors": _changes(predictions, new_p, "main_risk_factor"),
            "updated_recommendations": _changes(recommendations, new_r, *advice),
            "updated_segments": _changes(segments, new_s, "segment_id", "segment_name"),
            "recommendations_after": after.select("recommendations_after").scalar(),
            "segments_after": after.select("segments_after").scalar(),
        }
    )
    return Reconciled(report, new_p, new_s, new_r)


def _changes(old: DataFrame, new: DataFrame, *columns: str) -> Column:
    """Number of customers for whom any of the columns differs; tables bucketed alike are not shuffled."""
    renamed = new.select("customer_id", *(F.col(c).alias(f"__{c}") for c in columns))
    differs = reduce(or_, (~F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns))
    return old.join(renamed, "customer_id").agg(F.count_if(differs)).scalar()


def reconcile_results(results: ResultStore, customers: DataFrame) -> DataFrame:
    """Reconcile the published tables of a store, writing each once, and return the report."""
    found = results.published()
    with results.amending() as save:
        done = reconcile(
            found["predictions"], found["customer_segments"], found["customer_recommendations"], customers, save=save
        )
    return done.report
