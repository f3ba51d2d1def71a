"""Schemas of the logical tables."""

from __future__ import annotations

from pyspark.sql import types as T

_USAGE = []
for _part in ("day", "eve", "night", "intl"):
    _USAGE += [
        T.StructField(f"total_{_part}_minutes", T.DoubleType()),
        T.StructField(f"total_{_part}_calls", T.IntegerType()),
        T.StructField(f"total_{_part}_charge", T.DoubleType()),
    ]

CUSTOMERS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("dataset_split", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("account_length", T.IntegerType()),
        T.StructField("area_code", T.IntegerType()),
        T.StructField("international_plan", T.StringType()),
        T.StructField("voice_mail_plan", T.StringType()),
        T.StructField("number_vmail_messages", T.IntegerType()),
        *_USAGE,
        T.StructField("customer_service_calls", T.IntegerType()),
        T.StructField("churn", T.IntegerType()),
    ]
)

PREDICTIONS = T.StructType(
    [
        T.StructField("customer_id", T.StringType()),
        T.StructField("scoring_job_id", T.IntegerType()),
        T.StructField("churn_probability", T.DoubleType()),
        T.StructField("risk_group", T.StringType()),
        T.StructField("main_risk_factor", T.StringType()),
        T.StructField("estimated_total_charge", T.DoubleType()),
        T.StructField("scoring_date", T.TimestampType()),
    ]
)

SEGMENTS = T.StructType(
    [
        T.StructField("customer_id", T.StringType()),
        T.StructField("segment_id", T.IntegerType()),
        T.StructField("segment_name", T.StringType()),
    ]
)

RECOMMENDATIONS = T.StructType(
    [
        T.StructField("customer_id", T.StringType()),
        T.StructField("recommendation_type", T.StringType()),
        T.StructField("recommendation_reason", T.StringType()),
        T.StructField("priority", T.StringType()),
    ]
)

SCORING_JOBS = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("algorithm", T.StringType()),
        T.StructField("roc_auc", T.DoubleType()),
        T.StructField("f1_score", T.DoubleType()),
        T.StructField("recall", T.DoubleType()),
        T.StructField("high_risk_threshold", T.DoubleType()),
        T.StructField("medium_risk_threshold", T.DoubleType()),
        T.StructField("status", T.StringType()),
        T.StructField("scoring_date", T.TimestampType()),
    ]
)
