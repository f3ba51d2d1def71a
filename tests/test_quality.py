import pytest
from pyspark.sql import functions as F

from holdfast.operators import quality, reconcile
from holdfast.sources.results import KeyViolation, ResultStore
from tests.helpers import one, prediction, predictions, recommendations, segments


def test_empty_inputs_are_refused(spark):
    with pytest.raises(ValueError, match="Training data is empty"):
        quality.require_rows(training=spark.range(0))
    with pytest.raises(ValueError, match="test dataset"):
        quality.require_label(test=spark.range(1))


def test_keys_and_orphans(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "customer_id string")
    found = {r["key_value"]: r["rows_count"] for r in quality.key_problems(rows, "customer_id").collect()}
    assert found == {"a": 2, None: 1}
    parent = spark.createDataFrame([("a",)], "customer_id string")
    assert [r[0] for r in quality.orphans(rows, parent, "customer_id").collect()] == ["b"]


@pytest.fixture(scope="module")
def drifted(spark):
    p = predictions(
        spark,
        [
            prediction("A", 0.8, "High", "wrong", 40.0),
            prediction("B", 0.1, "Low", "High day charge", 70.0),
            prediction("X", 0.5, "Medium", None, 10.0),
        ],
    )
    s = segments(spark, [("A", 1, "Stable Customer Segment"), ("B", None, None), ("X", 3, "odd"), ("Y", 3, "odd")])
    r = recommendations(
        spark,
        [("A", "No Action", "r", "Low"), ("B", None, None, None), ("X", "Retention Discount", "r", "Medium"),
         ("Y", "odd", "odd", "odd")],
    )
    c = spark.createDataFrame(
        [("A", 3, 100.0, 10.0, " yes ", "no", 1.0, 1.0), ("B", None, 300.0, 10.0, "no", "yes", 1.0, 1.0)],
        "customer_id string, customer_service_calls int, total_day_minutes double, total_day_charge double, "
        "international_plan string, voice_mail_plan string, total_intl_minutes double, total_intl_charge double",
    )
    return p, s, r, c


def test_reconcile(drifted):
    p, s, r, c = drifted
    done = reconcile.reconcile(p, s, r, c)
    report = one(done.report).asDict()
    assert report == {
        "recommendations_before": 1, "segments_before": 2, "updated_risk_factors": 2,
        "updated_recommendations": 3, "updated_segments": 2, "recommendations_after": 0, "segments_after": 0,
    }
    factors = {x["customer_id"]: x["main_risk_factor"] for x in done.predictions.collect()}
    assert factors == {"A": "Customer service calls >= 3", "B": "Stable customer profile", "X": None}
    advice = {x["customer_id"]: (x["recommendation_type"], x["priority"]) for x in done.recommendations.collect()}
    assert advice == {
        "A": ("Service Recovery Call", "High"), "B": ("No Action", "Low"),
        "X": ("Retention Discount", "Medium"), "Y": ("odd", "odd"),
    }
    kept = {x["customer_id"]: (x["segment_id"], x["segment_name"]) for x in done.segments.collect()}
    assert kept == {
        "A": (1, "Service Issue Segment"), "B": (2, "Tariff Optimization Segment"), "X": (3, "odd"), "Y": (3, "odd"),
    }


def test_check_changes_nothing(drifted):
    done = reconcile.reconcile(*drifted, check_only=True)
    assert one(done.report).asDict() == {"recommendations_before": 1, "segments_before": 2}
    assert done.predictions is None


def test_reconciling_twice_changes_nothing(drifted):
    p, s, r, c = drifted
    done = reconcile.reconcile(p, s, r, c)
    again = one(reconcile.reconcile(done.predictions, done.segments, done.recommendations, c).report)
    assert [again[f"updated_{n}"] for n in ("risk_factors", "recommendations", "segments")] == [0, 0, 0]


def test_published_results_are_reconciled_in_place(spark, drifted, tmp_path):
    p, s, r, c = drifted
    store = ResultStore(spark, str(tmp_path), 2)
    # Results with a customer that has no prediction are refused; the other customers are published.
    with pytest.raises(KeyViolation, match="no prediction Y"):
        store.publish(store.create_job({}), p, s, r)
    known = F.col("customer_id") != "Y"
    store.publish(store.create_job({}), p, s.where(known), r.where(known))
    report = one(reconcile.reconcile_results(store, c)).asDict()
    assert (report["updated_risk_factors"], report["updated_recommendations"], report["updated_segments"]) == (2, 3, 2)
    again = one(reconcile.reconcile_results(store, c)).asDict()
    assert set(again.values()) == {0}


def test_missing_risk_group_is_no_contradiction(spark):
    p = predictions(spark, [prediction("A", group=None), prediction("B", group="Low"), prediction("C", group="High")])
    r = recommendations(spark, [("A", "No Action", "", ""), ("B", None, "", ""), ("C", "No Action", "", "")])
    assert [x["customer_id"] for x in quality.contradicting(p, r).collect()] == ["C"]
    assert quality.contradicting(p, r).where(F.col("risk_group") == "Low").isEmpty()
