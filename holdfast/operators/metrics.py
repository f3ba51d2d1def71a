"""Metrics of a binary score, for any number of groups in one plan.

Rows are first counted per distinct score, so equal scores arrive as one row per task
whatever their number. These counts can be added up; all measures come from them.
The area under the curve needs, per score, the negatives below it: a running count
within each of ``BINS`` ranges of the score, and another one over the ranges. No
window is as wide as a group, and nothing is written or read twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 65_536
METRICS = ("roc_auc", "f1_score", "recall", "precision", "accuracy")
NO_ROWS = {"roc_auc": None, **dict.fromkeys(METRICS[1:], 0.0)}


def score_counts(df: DataFrame, label: str, score: str, groups: list[str]) -> DataFrame:
    """Positive and negative rows per group and distinct score; rows without a label or score are left out."""
    known = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    return known.groupBy(*groups, F.col(score).cast("double").alias("__score")).agg(
        F.count_if(F.col(label) == 1).alias("__pos"), F.count_if(F.col(label) != 1).alias("__neg")
    )


def _bin() -> Column:
    """The range of a score, in score order. The outer ranges are open; NaN is above all."""
    return F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), "__score")) * (BINS - 1))


def _pairs(positives: str, negatives: Column) -> Column:
    """Exact products: counts of a large table multiply beyond 64 bits."""
    return F.col(positives).cast("decimal(18,0)") * negatives.cast("decimal(19,0)")


def binary_metrics(
    df: DataFrame, label: str = "churn", score: str = "churn_probability", groups: list[str] | None = None
) -> DataFrame:
    """ROC-AUC (NULL if only one class occurs), and F1, recall, precision and accuracy at 0.5 (0 for 0 / 0).

    One row per group that has rows; without groups one row, also of an empty table.
    """
    groups = groups or []
    counts = score_counts(df, label, score, groups).withColumn("__bin", _bin())
    before = Window.partitionBy(*groups, "__bin").orderBy("__score").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("__neg").over(before), F.lit(0))
    called = F.col("__score") >= 0.5
    bins = (
        counts.withColumn("__pairs", _pairs("__pos", 2 * below + F.col("__neg")))
        .groupBy(*groups, "__bin")
        .agg(
            F.sum("__pairs").alias("__pairs"),
            F.sum("__pos").alias("__pos"),
            F.sum("__neg").alias("__neg"),
            F.sum(F.when(called, F.col("__pos"))).alias("__tp"),
            F.sum(F.when(called, F.col("__neg"))).alias("__fp"),
        )
    )
    lower = Window.partitionBy(*groups).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    negatives_below = F.coalesce(F.sum("__neg").over(lower), F.lit(0))
    totals = (
        bins.withColumn("__across", _pairs("__pos", 2 * negatives_below))
        .groupBy(*groups)
        .agg(
            (F.sum("__pairs") + F.sum("__across")).cast("double").alias("__area"),
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("__pos", "__neg", "__tp", "__fp")],
        )
    )
    pos, neg, tp, fp = (F.col(c) for c in ("__pos", "__neg", "__tp", "__fp"))

    def ratio(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(0.0)

    both = (pos > 0) & (neg > 0)
    return totals.select(
        *groups,
        F.when(both, F.col("__area") / (2.0 * pos * neg)).alias("roc_auc"),
        ratio(2 * tp, tp + fp + pos).alias("f1_score"),
        ratio(tp, pos).alias("recall"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp + neg - fp, pos + neg).alias("accuracy"),
    )
