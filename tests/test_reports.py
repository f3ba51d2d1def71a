from collections import Counter, defaultdict
from datetime import datetime
import random

import pytest
from pyspark.sql import functions as F

from holdfast import schemas
from holdfast.functions import labels as L
from holdfast.operators import reports
from tests.helpers import one, prediction, predictions, recommendations, segments

GROUPS = ["High", "Medium", "Low", None]
FACTORS = [*L.FACTOR_ORDER, None, "Other"]
NAMES = [(1, L.SERVICE_SEGMENT), (2, "Old Segment"), (None, None), (4, L.STABLE_SEGMENT)]
ACTIONS = [*L.REASONS, None]


@pytest.fixture(scope="module")
def random_rows():
    """Rows in which one segment, factor and action hold most customers."""
    source = random.Random(11)

    def skewed(options):
        return options[0] if source.random() < 0.4 else source.choice(options)

    p, s, r = [], [], []
    for i in range(1500):
        name = f"C{i:05d}"
        probability = None if source.random() < 0.05 else source.randint(0, 10000) / 10000
        charge = None if source.random() < 0.05 else source.randint(100, 12000) / 100
        p.append(prediction(name, probability, skewed(GROUPS), skewed(FACTORS), charge))
        if source.random() < 0.9:
            s.append((name, *skewed(NAMES)))
        if source.random() < 0.9:
            action = skewed(ACTIONS)
            r.append((name, action, source.choice(["a", "b", None]), source.choice(["High", "Low", None])))
    return p, s, r


@pytest.fixture(scope="module")
def tables(spark, random_rows):
    p, s, r = random_rows
    return predictions(spark, p), segments(spark, s), recommendations(spark, r)


def top(values, tie=lambda v: 0):
    counted = Counter(v for v in values if v is not None)
    return min(counted, key=lambda v: (-counted[v], tie(v), v)) if counted else None


def mean(values):
    known = [v for v in values if v is not None]
    return sum(known) / len(known) if known else 0.0


def joined(random_rows):
    p, s, r = random_rows
    seg = {row[0]: row[1:] for row in s}
    rec = {row[0]: row[1:] for row in r}
    return [
        dict(id=c, p=prob, group=g, factor=f, charge=charge, seg=seg.get(c), rec=rec.get(c))
        for c, _, prob, g, f, charge, _ in p
    ]


def segment_cells(tables):
    rows = tables[0].join(tables[1], "customer_id").join(tables[2], "customer_id", "left")
    return reports.cells(
        rows, "segment_id", "segment_name", "risk_group", "main_risk_factor", "recommendation_type"
    )


def test_segment_summary_against_brute_force(tables, random_rows):
    found = {(r["segment_id"], r["segment_name"]): r for r in reports.segment_summary(segment_cells(tables)).collect()}
    groups = defaultdict(list)
    for row in joined(random_rows):
        if row["seg"] is not None:
            groups[row["seg"]].append(row)
    assert set(found) == set(groups)
    for key, rows in groups.items():
        got = found[key]
        assert got["clients_count"] == len(rows)
        assert got["high_risk_customers"] == sum(r["group"] == "High" for r in rows)
        assert got["average_churn_probability"] == pytest.approx(mean([r["p"] for r in rows]))
        assert got["average_estimated_total_charge"] == pytest.approx(mean([r["charge"] for r in rows]))
        actions = [r["rec"][0] for r in rows if r["rec"] and r["rec"][0] != L.NO_ACTION]
        action = top(actions) if key[1] else None
        assert got["main_recommendation"] == (action or L.NO_ACTION)
        if key[1] in L.SEGMENT_FACTOR:
            assert got["main_risk_factor"] == L.SEGMENT_FACTOR[key[1]]
        elif action in L.ACTION_FACTOR:
            assert got["main_risk_factor"] == L.ACTION_FACTOR[action]


def test_one_pass_summary_equals_ranked_joins(tables):
    cells, key = segment_cells(tables), ["segment_id", "segment_name"]
    ranked = reports.with_leaders(reports.segment_stats(cells, key), cells, key)
    actions = {tuple(r[k] for k in key): r["recommendation_type"] for r in ranked.collect()}
    for row in reports.segment_summary(cells).collect():
        assert row["main_recommendation"] == (actions[tuple(row[k] for k in key)] or L.NO_ACTION)


def test_factor_ties_follow_factor_order(spark):
    """An old segment name without active recommendations falls back to its factors."""
    rows = [prediction(f"C{i}", 0.2, "Low", f) for i, f in enumerate([L.INTL_FACTOR, L.CALLS_FACTOR, L.STABLE_FACTOR] * 2)]
    cells = segment_cells(
        (predictions(spark, rows), segments(spark, [(r[0], 9, "Old") for r in rows]),
         recommendations(spark, [(r[0], L.NO_ACTION, None, None) for r in rows]))
    )
    found = one(reports.segment_summary(cells))
    assert (found["main_risk_factor"], found["main_recommendation"]) == (L.CALLS_FACTOR, L.NO_ACTION)


def test_plan_against_brute_force(tables, random_rows):
    rows = tables[0].join(tables[2], "customer_id")
    cells = reports.cells(
        rows, "recommendation_type", "recommendation_reason", "priority", "main_risk_factor", "risk_group"
    )
    found = {r["recommendation_type"]: r for r in reports.recommendation_plan(cells).collect()}
    groups = defaultdict(list)
    for row in joined(random_rows):
        if row["rec"] and row["rec"][0] not in (None, L.NO_ACTION):
            groups[row["rec"][0]].append(row)
    assert set(found) == set(groups)
    for action, members in groups.items():
        got = found[action]
        assert got["customers_count"] == len(members)
        assert got["high_priority_customers"] == sum(m["rec"][2] == "High" for m in members)
        assert got["recommendation_reason"] == top([m["rec"][1] for m in members])
        assert got["priority"] == top([m["rec"][2] for m in members])
        assert got["main_risk_factor"] == top([m["factor"] for m in members])
        revenue = sum(m["p"] * m["charge"] for m in members if m["p"] is not None and m["charge"] is not None)
        assert got["estimated_revenue_at_risk"] == pytest.approx(revenue)
    revenues = [r["estimated_revenue_at_risk"] for r in reports.recommendation_plan(cells).collect()]
    assert revenues == sorted(revenues, reverse=True)


def test_priority_segments_keep_the_nameless_one(tables, random_rows):
    found = reports.priority_segments(segment_cells(tables), 10).collect()
    nameless = [r for r in found if r["segment"] is None]
    rows = [r for r in joined(random_rows) if r["seg"] == (None, None)]
    assert len(nameless) == 1
    assert nameless[0]["main_risk_factor"] == top([r["factor"] for r in rows])


def test_dashboard_sections_equal_single_reports(spark, tables):
    p, s, r = tables
    found = reports.dashboard_summary(p, s, r, spark.createDataFrame([], schemas.SCORING_JOBS))
    members = p.join(s, "customer_id")
    single = {
        "risk_distribution": reports.risk_distribution(reports.cells(p, "risk_group")),
        "high_risk_share_by_segment": reports.high_risk_share_by_segment(
            reports.cells(members, "segment_name", "risk_group")
        ),
        "recommendations_summary": reports.recommendation_counts(
            reports.cells(p.join(r, "customer_id"), "recommendation_type")
        ),
        "top_risk_factors": reports.top_risk_factors(reports.cells(p, "risk_group", "main_risk_factor")),
    }
    for name, df in single.items():
        assert found[name].collect() == df.collect(), name
    assert len(found) == 8
    assert one(found["kpis"])["total_customers"] == p.count()


def test_key_figures_of_nothing(spark):
    cells = reports.cells(predictions(spark, []), "risk_group")
    assert one(reports.key_figures(cells)).asDict() == {
        "total_customers": 0, "high_risk_customers": 0, "average_churn_probability": 0.0,
        "estimated_revenue_at_risk": 0.0, "last_scoring_date": None,
    }
    blank = one(reports.key_figures(cells, blanks=True))
    assert blank["total_customers"] == 0 and blank["high_risk_customers"] is None
    assert reports.risk_distribution(cells).isEmpty()


def test_top_factors_and_impact(spark):
    rows = [prediction(f"C{i}", 0.9, "High", f) for i, f in enumerate(["a"] * 70 + ["b"] * 25 + ["c"] * 5 + ["d"] * 3)]
    rows += [prediction("N", 0.9, "High", None), prediction("L", 0.1, "Low", "a")]
    found = reports.top_risk_factors(reports.cells(predictions(spark, rows), "risk_group", "main_risk_factor"), 3)
    assert [(r["factor"], r["customers_count"], r["impact"]) for r in found.collect()] == [
        ("a", 70, "High"), ("b", 25, "Medium"), ("c", 5, "Low"),
    ]


def job(number, status="success", metrics=(0.9, 0.8, 0.7), date=1, high=0.7):
    when = datetime(2024, 1, date) if date else None
    return (number, "model", f"v{number}", "Gradient Boosting", *metrics, high, 0.35, status, when)


def test_scoring_info(spark):
    none = (None, None, None)
    jobs = spark.createDataFrame(
        [job(1, date=1), job(2, metrics=none, date=2, high=None), job(3, "failed", date=4), job(4, "running", none, 3)],
        schemas.SCORING_JOBS,
    )
    found = one(reports.scoring_info(jobs))
    assert (found["model_version"], found["roc_auc"]) == ("v2", 0.9)
    assert found["last_scoring_date"] == "2024-01-02 00:00:00"
    assert found["last_training_date"] == "2024-01-01 00:00:00"
    assert (found["high_risk_threshold"], found["medium_risk_threshold"]) == (0.7, 0.35)
    assert one(reports.latest_success(jobs))["id"] == 2
    assert one(reports.latest_success(jobs, with_metrics=True))["id"] == 1


def test_undated_success_is_the_latest(spark):
    jobs = spark.createDataFrame([job(1, date=9), job(5, date=None)], schemas.SCORING_JOBS)
    assert one(reports.latest_success(jobs))["id"] == 5
    found = one(reports.scoring_info(jobs))
    assert found["model_version"] == "v5" and found["last_scoring_date"] is None


def test_scoring_info_without_jobs(spark):
    found = one(reports.scoring_info(spark.createDataFrame([], schemas.SCORING_JOBS)))
    assert found["model_name"] is None and found["high_risk_threshold"] == 0.7


def test_active_counts_keep_missing_types(spark):
    counts = spark.createDataFrame(
        [("No Action", 5), ("x", 3), (None, 2)], "recommendation_type string, customers_count bigint"
    )
    assert one(reports.active_total(counts))["active_recommendations"] == 5
    assert reports.top_actions(counts, 1).first()["recommendation_type"] == "x"
    assert one(reports.active_total(counts.where(F.lit(False))))["active_recommendations"] == 0
