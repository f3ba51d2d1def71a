"""What the physical plans must and must not contain."""

import re

import pytest
from holdfast.functions import labels as L
from holdfast.operators import customers, features, numbering, quality, reconcile, reports, scoring
from holdfast.operators.filters import CustomerFilter
from holdfast.plans import runs
from holdfast.queries.aggregates import segment_cells
from holdfast.session import scratch_path
from holdfast.sources import buckets
from holdfast.sources.customers import customers_in_splits
from holdfast.sources.results import ResultStore


def plan(df) -> str:
    """The physical plan before adaptive execution changes it."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[-1]


@pytest.fixture
def large(spark):
    """Joins as for tables too large to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_result_tables_join_without_shuffle(logical, large):
    text = plan(customers.result_rows(*logical.result_tables))
    assert text.count("SortMergeJoin") == 2
    assert "Exchange" not in text


def test_page_shuffles_no_table(logical, large):
    chosen = CustomerFilter(min_probability=0.3)
    text = plan(customers.customer_list(*logical.result_tables, chosen, 100, 20))
    # the page was computed and written before; each table is scanned once, for the semi join with its keys
    assert text.count("LeftSemi, BuildRight") == 2
    assert sum("customer_segments" in line or "segment_name:string" in line for line in text.splitlines() if "FileScan" in line) == 1
    for before, after in zip(text.splitlines(), text.splitlines()[1:]):
        if "Exchange hashpartitioning" in before:
            assert "FileScan" not in after or "holdfast-" in after
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    scope, _ = customers.page_scope(chosen.apply(logical.predictions), 100, 20)
    text = plan(scope.orderBy(*customers._order()).offset(20).limit(100))
    assert "TakeOrderedAndProject" in text and text.count("FileScan") == 1
    assert "PushedFilters: [IsNotNull(churn_probability), GreaterThanOrEqual(churn_probability,0.3)" in text


def test_point_lookup_reads_one_bucket(logical, large):
    text = plan(customers.customer_detail(*logical.result_tables, "C00100"))
    assert text.count("SelectedBucketsCount: 1 out of 8") == 3
    assert text.count("EqualTo(customer_id,C00100)") == 3


def test_segment_summary_reads_each_table_once(logical, large):
    text = plan(reports.segment_summary(segment_cells(logical)))
    assert text.count("FileScan parquet") == 3
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_split_scan_is_pushed_down(logical):
    text = plan(customers_in_splits(logical.customers, ["train"], ordered=False))
    assert "Exchange" not in text
    assert "EqualTo(dataset_split,train)" in text or "In(dataset_split, [train])" in text
    assert "scoring_date" not in text


def test_rules_need_no_python_and_no_shuffle(logical):
    scored = scoring.enrich_predictions(features.prepare_features(logical.inputs))
    for df in (scored, scoring.customer_segments(scored), scoring.customer_recommendations(scored)):
        text = plan(df)
        assert "Exchange" not in text and "Python" not in text


def test_split_assignment_moves_no_rows(logical):
    text = plan(numbering.ordered_split(logical.customers.select("id", "state")))
    assert "Exchange" not in text and "Window" not in text


def test_reconciliation_shuffles_no_table(logical, large):
    fixed = reconcile.reconcile_factors(logical.drifted_predictions, logical.customers)
    advice = reconcile.reconcile_recommendations(logical.recommendations, logical.predictions)
    segments = reconcile.reconcile_segments(logical.segments, logical.predictions, logical.customers)
    for df in (fixed, advice, segments):
        assert "Exchange" not in plan(df)


def test_rows_bucketed_alike_are_written_without_shuffle(logical):
    """``write_bucketed`` repartitions by customer, which these rows already are."""
    advice = scoring.customer_recommendations(logical.predictions)
    assert "Exchange" not in plan(advice.repartition(logical.buckets, "customer_id"))


def test_segment_filter_makes_the_join_inner(logical, large):
    chosen = CustomerFilter(segment=L.STABLE_SEGMENT)
    rows = chosen.apply(customers.result_rows(*logical.result_tables))
    assert re.search(r"SortMergeJoin.*Inner", plan(rows))


def test_counts_are_combined_before_the_shuffle(logical):
    text = plan(reports.risk_distribution(reports.cells(logical.predictions, "risk_group")))
    assert "partial_count(1)" in text
    assert "ReadSchema: struct<risk_group:string>" in text


def test_a_run_on_defaults_reconciles_without_moving_customers(spark, logical, large, monkeypatch):
    """The run scores a tenth of the customers, but takes its bucket count from all of them."""
    monkeypatch.setattr(buckets, "ROWS_PER_BUCKET", 10)
    path = scratch_path(spark, "customers")
    count = buckets.buckets_for(logical.customers.count())
    assert count > 8
    buckets.write_bucketed(logical.customers, path, count)
    customer_table = buckets.read_bucketed(spark, path, logical.customers.schema, count)
    store = ResultStore(spark, scratch_path(spark, "results"))
    batch = logical.inputs.where("dataset_split = 'scoring_batch'")
    monkeypatch.setattr(runs, "score_customers", lambda features, model: features)
    runs.score_and_save(batch, None, store, store.create_job({}), customer_table)
    p, s, r = (store.published()[n] for n in ("predictions", "customer_segments", "customer_recommendations"))
    for df in (
        reconcile.reconcile_factors(p, customer_table),
        reconcile.reconcile_segments(s, p, customer_table),
        quality.drifted_segments(s, p, customer_table),
    ):
        assert "Exchange" not in plan(df)
