"""Binary metrics against their definitions."""

import random

import pytest

from holdfast.operators import metrics
from tests.helpers import one

SCHEMA = "g string, churn int, churn_probability double"


def by_definition(rows):
    """Metrics of (label, score) pairs; every positive is compared with every negative."""
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    won = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    tp, fp = sum(p >= 0.5 for p in pos), sum(n >= 0.5 for n in neg)

    def ratio(part, whole):
        return part / whole if whole else 0.0

    return {
        "roc_auc": won / (len(pos) * len(neg)) if pos and neg else None,
        "f1_score": ratio(2 * tp, len(pos) + tp + fp),
        "recall": ratio(tp, len(pos)),
        "precision": ratio(tp, tp + fp),
        "accuracy": ratio(tp + len(neg) - fp, len(rows)),
    }


def same(found, wanted):
    assert found["roc_auc"] == (wanted["roc_auc"] if wanted["roc_auc"] is None else pytest.approx(wanted["roc_auc"], abs=1e-12))
    assert {k: found[k] for k in metrics.METRICS[1:]} == pytest.approx({k: wanted[k] for k in metrics.METRICS[1:]})


def test_groups_against_all_pairs(spark):
    """Ties, scores that share a range, scores beyond 0 and 1, a hot score, one class, and a NULL group."""
    draw = random.Random(3)
    rows = [("ties", draw.randint(0, 1), draw.randint(0, 9) / 10) for _ in range(300)]
    rows += [("close", draw.randint(0, 1), 0.25 + draw.randint(0, 50) * 1e-9) for _ in range(200)]
    rows += [("wide", draw.randint(0, 1), draw.choice([-3.0, -0.0, 0.0, 1.0, 7.5, float("inf"), -float("inf")])) for _ in range(200)]
    rows += [("hot", int(k % 3 == 0), 0.5 if k % 2 else k / 400) for k in range(400)]
    rows += [("single", 1, 0.2), ("single", 1, 0.8), (None, 0, 0.9), (None, 1, 0.1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    found = {r["g"]: r for r in metrics.binary_metrics(df, groups=["g"]).collect()}
    assert set(found) == {"ties", "close", "wide", "hot", "single", None}
    for group, measured in found.items():
        same(measured, by_definition([(y, p) for g, y, p in rows if g == group]))


def test_unknown_labels_and_scores_are_left_out(spark):
    rows = [("a", 1, 0.9), ("a", 0, 0.1), ("a", None, 0.9), ("a", 1, None)]
    same(one(metrics.binary_metrics(spark.createDataFrame(rows, SCHEMA))), by_definition([(1, 0.9), (0, 0.1)]))


def test_nan_is_above_all(spark):
    rows = [("a", 1, float("nan")), ("a", 0, 1.0), ("a", 0, 2.0)]
    assert one(metrics.binary_metrics(spark.createDataFrame(rows, SCHEMA)))["roc_auc"] == 1.0


def test_empty_table(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert one(metrics.binary_metrics(nothing)).asDict() == metrics.NO_ROWS
    assert metrics.binary_metrics(nothing, groups=["g"]).isEmpty()


def test_counts_of_parts_add_up(spark):
    """Scores that a hundred thousand rows share are one row after the first step."""
    df = spark.range(100_000).selectExpr("'a' AS g", "cast(id % 2 AS int) AS churn", "0.5D AS churn_probability")
    counts = one(metrics.score_counts(df, "churn", "churn_probability", ["g"]))
    assert (counts["__pos"], counts["__neg"]) == (50_000, 50_000)
