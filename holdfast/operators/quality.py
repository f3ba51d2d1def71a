"""Checks on inputs and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions import labels as L
from holdfast.functions import rules


def require_rows(**datasets: DataFrame) -> None:
    for name, df in datasets.items():
        if df.isEmpty():
            raise ValueError(f"{name.title()} data is empty.")


def require_label(**datasets: DataFrame) -> None:
    for name, df in datasets.items():
        if "churn" not in df.columns:
            raise ValueError(f"Column 'churn' is required in the {name} dataset")


def input_checks(df: DataFrame) -> DataFrame:
    """Rows, missing labels and missing ids of each split."""
    return df.groupBy("dataset_split").agg(
        F.count("*").alias("rows_count"),
        F.count_if(F.col("churn").isNull()).alias("missing_labels"),
        F.count_if(F.col("customer_id").isNull()).alias("missing_ids"),
    )


def contradicting(predictions: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Recommendations that contradict the risk group."""
    low = F.col("risk_group") == "Low"
    idle = F.col("recommendation_type") == L.NO_ACTION
    return recommendations.join(
        predictions.select("customer_id", "risk_group"), "customer_id"
    ).where((low & ~idle) | (~low & idle))


def expected_segment(trim: str = "spaces"):
    return rules.segment(
        F.col("customer_service_calls"),
        F.col("total_day_minutes"),
        F.col("total_day_charge"),
        F.col("estimated_total_charge"),
        F.col("international_plan"),
        F.col("total_intl_minutes"),
        F.col("total_intl_charge"),
        trim,
    )


SEGMENT_INPUTS = (
    "customer_service_calls", "total_day_minutes", "total_day_charge", "international_plan",
    "total_intl_minutes", "total_intl_charge",
)


def drifted_segments(segments: DataFrame, predictions: DataFrame, customers: DataFrame) -> DataFrame:
    """Segments that differ from the rule."""
    known = segments.join(
        predictions.select("customer_id", "estimated_total_charge"), "customer_id"
    ).join(customers.select("customer_id", *SEGMENT_INPUTS), "customer_id")
    expected = known.withColumn("expected", expected_segment())
    return expected.where(
        ~F.col("segment_id").eqNullSafe(F.col("expected.segment_id"))
        | ~F.col("segment_name").eqNullSafe(F.col("expected.segment_name"))
    )


def counted(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias(name))


def key_problems(df: DataFrame, key: str) -> DataFrame:
    """Keys that are NULL or occur more than once, with the number of rows."""
    found = df.groupBy(F.col(key).alias("key_value")).agg(F.count("*").alias("rows_count"))
    return found.where(F.col("key_value").isNull() | (F.col("rows_count") > 1))


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Rows whose key has no row in the parent table; a NULL key refers to nothing."""
    known = parent.select(F.col(parent_key or key).alias(key))
    return child.where(F.col(key).isNotNull()).join(known, key, "left_anti")
