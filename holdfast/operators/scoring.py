"""From scored customers to risk groups, segments and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions import rules
from holdfast.operators.features import optional


def require_columns(df: DataFrame, *names: str) -> None:
    for name in names:
        if name not in df.columns:
            raise ValueError(f"Missing column: {name}")


def enrich_predictions(df: DataFrame) -> DataFrame:
    """Add the risk group and the main risk factor."""
    factor = rules.main_risk_factor(
        optional(df, "customer_service_calls", "double"),
        optional(df, "total_day_charge", "double"),
        optional(df, "international_plan", "string"),
        optional(df, "voice_mail_plan", "string"),
    )
    return df.withColumns(
        {"risk_group": rules.risk_group(F.col("churn_probability")), "main_risk_factor": factor}
    )


def customer_segments(df: DataFrame) -> DataFrame:
    require_columns(df, "customer_id")
    chosen = rules.segment(
        optional(df, "customer_service_calls", "double"),
        optional(df, "total_day_minutes", "double"),
        optional(df, "total_day_charge", "double"),
        optional(df, "estimated_total_charge", "double"),
        optional(df, "international_plan", "string"),
        optional(df, "total_intl_minutes", "double"),
        optional(df, "total_intl_charge", "double"),
    )
    return df.select("customer_id", chosen.alias("s")).select("customer_id", "s.*")


def customer_recommendations(df: DataFrame) -> DataFrame:
    require_columns(df, "customer_id")
    chosen = rules.recommendation(
        optional(df, "main_risk_factor", "string"),
        optional(df, "churn_probability", "double"),
        optional(df, "estimated_total_charge", "double"),
    )
    return df.select("customer_id", chosen.alias("r")).select("customer_id", "r.*")
