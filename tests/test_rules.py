import pytest
from pyspark.sql import functions as F

from holdfast.functions import rules
from holdfast.operators import features, scoring
from tests.helpers import one


def advise(spark, **values):
    row = spark.createDataFrame([("C1", *values.values())], ["customer_id", *values])
    return one(scoring.customer_recommendations(row))


def test_low_risk_needs_no_action(spark):
    found = advise(spark, churn_probability=0.2, main_risk_factor="No voice mail plan")
    assert found["recommendation_type"] == "No Action"
    assert found["priority"] == "Low"


def test_elevated_risk_without_factor_gets_discount(spark):
    found = advise(spark, churn_probability=0.5, main_risk_factor="Stable customer profile")
    assert found["recommendation_type"] == "Retention Discount"


@pytest.mark.parametrize(
    "probability, charge, factor, expected",
    [
        (0.4, 40.0, "Customer service calls >= 3", "Medium"),
        (0.8, 80.0, "High day charge", "High"),
        (0.6, 90.0, "High day charge", "High"),
        (0.34, 150.0, "High day charge", "Low"),
    ],
)
def test_priority(spark, probability, charge, factor, expected):
    found = advise(
        spark, churn_probability=probability, estimated_total_charge=charge, main_risk_factor=factor
    )
    assert found["priority"] == expected


def test_revenue_alone_raises_plain_priority(spark):
    row = spark.range(1).select(rules.priority(F.lit(0.34), F.lit(150.0)).alias("p"))
    assert one(row)["p"] == "High"


def test_day_charge_outranks_international_plan(spark):
    row = spark.createDataFrame(
        [("C1", 0.8, 1, 45.0, "yes", "no")],
        ["customer_id", "churn_probability", "customer_service_calls", "total_day_charge",
         "international_plan", "voice_mail_plan"],
    )
    enriched = scoring.enrich_predictions(row)
    assert one(enriched)["main_risk_factor"] == "High day charge"
    assert one(scoring.customer_recommendations(enriched))["recommendation_type"] == "Tariff Optimization"


@pytest.mark.parametrize("calls, expected", [(4, (1, "Service Issue Segment")), (1, (2, "Tariff Optimization Segment"))])
def test_segment_with_absent_columns(spark, calls, expected):
    row = spark.createDataFrame(
        [("C1", 0.9, 80.0, calls)],
        ["customer_id", "churn_probability", "estimated_total_charge", "customer_service_calls"],
    )
    found = one(scoring.customer_segments(row))
    assert (found["segment_id"], found["segment_name"]) == expected


def test_segment_needs_customer_id(spark):
    with pytest.raises(ValueError, match="customer_id"):
        scoring.customer_segments(spark.range(1))


@pytest.mark.parametrize(
    "probability, expected",
    [(0.35, "Medium"), (0.7, "High"), (0.3499999, "Low"), (0.6999999, "Medium")],
)
def test_risk_group_limits(spark, probability, expected):
    assert one(spark.range(1).select(rules.risk_group(F.lit(probability)).alias("g")))["g"] == expected


def test_missing_calls_fall_through(spark):
    rows = spark.createDataFrame(
        [(float("nan"), 10.0), (None, 10.0)], "customer_service_calls double, total_day_charge double"
    )
    found = scoring.enrich_predictions(
        features.nan_to_null(rows).withColumn("churn_probability", F.lit(0.1))
    ).collect()
    assert [r["main_risk_factor"] for r in found] == ["Stable customer profile"] * 2


def test_padded_plan_text(spark):
    plan = F.lit(" Yes ")

    def factor(trim):
        return rules.main_risk_factor(F.lit(0), F.lit(0.0), plan, F.lit("yes"), trim)

    row = one(
        spark.range(1).select(
            factor("none").alias("scoring"),
            factor("spaces").alias("reconciling"),
            rules.says_yes(plan).alias("segment"),
        )
    )
    assert row["scoring"] == "Stable customer profile"
    assert row["reconciling"] == "International plan"
    assert row["segment"] is True


@pytest.mark.parametrize(
    "value, expected", [("TRUE", "yes"), ("0", "no"), ("Maybe", "maybe"), (None, "none"), (" Yes", " yes")]
)
def test_plan_text(spark, value, expected):
    rows = spark.createDataFrame([(value,)], "international_plan string")
    assert one(features.normalize_plans(rows))["international_plan"] == expected


def test_total_charge_with_null_and_absent_columns(spark):
    rows = spark.createDataFrame([(1.5, None)], "total_day_charge double, total_eve_charge double")
    found = one(features.add_estimated_total_charge(rows))
    assert found["estimated_total_charge"] == 1.5
    assert found["total_intl_charge"] == 0


def test_ids_of_six_digits(spark):
    rows = spark.createDataFrame([(123456, None), (42, None), (7, "X")], "id int, customer_id string")
    whole = [r["customer_id"] for r in features.backfill_customer_ids(rows).orderBy("id").collect()]
    cut = [r["customer_id"] for r in features.backfill_customer_ids(rows, truncate=True).orderBy("id").collect()]
    assert whole == ["X", "C00042", "C123456"]
    assert cut == ["X", "C00042", "C12345"]


def test_existing_customer_ids_stay(spark):
    rows = spark.createDataFrame([("A",)], "customer_id string")
    assert features.add_customer_ids(rows, ["customer_id"]) is rows


def test_absent_customer_ids_are_numbered(spark):
    rows = spark.createDataFrame([(30,), (10,), (20,)], "total_day_charge int")
    found = features.prepare_features(rows, ["total_day_charge"]).collect()
    assert {r["total_day_charge"]: r["customer_id"] for r in found} == {10: "C00001", 20: "C00002", 30: "C00003"}
    anyhow = features.prepare_features(rows).collect()
    assert sorted(r["customer_id"] for r in anyhow) == ["C00001", "C00002", "C00003"]
