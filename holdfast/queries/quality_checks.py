"""Checks and reconciliation, over tables that have drifted from the rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdfast.operators import quality, reconcile
from holdfast.queries.registry import query
from holdfast.queries.tables import Tables
from holdfast.sources.buckets import part_of
from holdfast.sources.results import ResultStore


@query(
    "q01_input_checks",
    """SELECT dataset_split, count(*) AS rows_count, count(*) FILTER (churn IS NULL) AS missing_labels,
  count(*) FILTER (customer_id IS NULL) AS missing_ids FROM raw GROUP BY 1""",
)
def q01(t: Tables):
    return quality.input_checks(t.customers)


CONTRADICTING = """SELECT count(*) FROM {rec} JOIN {pred} USING (customer_id)
  WHERE (risk_group = 'Low') <> (recommendation_type = 'No Action')"""
DRIFTED = """SELECT count(*) FROM {seg} JOIN ruled USING (customer_id)
  WHERE segment_id <> rule_segment_id OR segment_name <> rule_segment_name"""


@query(
    "q02_contradicting_recommendations",
    f"SELECT ({CONTRADICTING.format(rec='rec_d', pred='pred')}) AS contradicting",
)
def q02(t: Tables):
    return quality.counted(
        quality.contradicting(t.predictions, t.drifted_recommendations), "contradicting"
    )


@query("q03_drifted_segments", f"SELECT ({DRIFTED.format(seg='seg_d')}) AS drifted")
def q03(t: Tables):
    return quality.counted(
        quality.drifted_segments(t.drifted_segments, t.predictions, t.customers), "drifted"
    )


@query(
    "q04_key_problems",
    """SELECT CAST(o_custkey AS VARCHAR) AS key_value, count(*) AS rows_count FROM orders GROUP BY 1
  HAVING count(*) > 1 OR o_custkey IS NULL""".replace("o_custkey IS NULL", "any_value(o_custkey) IS NULL"),
)
def q04(t: Tables):
    """Orders have many rows per customer, so the check has something to find."""
    orders = t.star("orders").selectExpr("CAST(o_custkey AS STRING) AS o_custkey")
    return quality.key_problems(orders, "o_custkey")


@query("q04_customer_keys", "SELECT customer_id AS key_value, count(*) AS rows_count FROM raw GROUP BY 1 HAVING count(*) > 1")
def q04_customers(t: Tables):
    return quality.key_problems(t.customers, "customer_id")


@query(
    "q05_orphans",
    """SELECT customer_id FROM pred ANTI JOIN seg USING (customer_id)""",
)
def q05(t: Tables):
    """Predictions without a segment: the missing segments make them orphans here."""
    return quality.orphans(t.predictions.select("customer_id"), t.segments, "customer_id")


@query(
    "r01_reconciled_factors",
    """SELECT customer_id, churn_probability, risk_group, scored.main_risk_factor,
  scored.main_risk_factor <> pred_d.main_risk_factor AS changed
  FROM pred_d JOIN scored USING (customer_id, churn_probability, risk_group)""",
)
def r01(t: Tables):
    fixed = reconcile.reconcile_factors(t.drifted_predictions, t.customers)
    return fixed.select("customer_id", "churn_probability", "risk_group", "main_risk_factor", "changed")


@query(
    "r02_reconciled_recommendations",
    """SELECT x.customer_id, x.recommendation_type, x.recommendation_reason, x.priority,
  r.recommendation_type IS DISTINCT FROM x.recommendation_type OR r.priority IS DISTINCT FROM x.priority
    AS changed FROM rec_d r JOIN rec x USING (customer_id)""",
)
def r02(t: Tables):
    return reconcile.reconcile_recommendations(t.drifted_recommendations, t.predictions)


@query(
    "r03_reconciled_segments",
    """SELECT x.customer_id, x.segment_id, x.segment_name, s.segment_id <> x.segment_id AS changed
  FROM seg_d s JOIN seg x USING (customer_id)""",
)
def r03(t: Tables):
    return reconcile.reconcile_segments(t.drifted_segments, t.predictions, t.customers)


@query(
    "r04_reconcile_report",
    f"""SELECT ({CONTRADICTING.format(rec='rec_d', pred='pred_d')}) AS recommendations_before,
  ({DRIFTED.format(seg='seg_d')}) AS segments_before,
  (SELECT count(*) FROM pred_d JOIN pred USING (customer_id)
    WHERE pred.main_risk_factor <> pred_d.main_risk_factor) AS updated_risk_factors,
  (SELECT count(*) FROM rec_d r JOIN rec x USING (customer_id)
    WHERE r.recommendation_type <> x.recommendation_type OR r.priority IS DISTINCT FROM x.priority)
    AS updated_recommendations,
  (SELECT count(*) FROM seg_d s JOIN seg x USING (customer_id) WHERE s.segment_id <> x.segment_id)
    AS updated_segments,
  CAST(0 AS BIGINT) AS recommendations_after, CAST(0 AS BIGINT) AS segments_after""",
)
def r04(t: Tables):
    done = reconcile.reconcile(
        t.drifted_predictions, t.drifted_segments, t.drifted_recommendations, t.customers
    )
    return done.report


@query(
    "r04_check_only",
    f"""SELECT ({CONTRADICTING.format(rec='rec_d', pred='pred_d')}) AS recommendations_before,
  ({DRIFTED.format(seg='seg_d')}) AS segments_before""",
)
def r04_check(t: Tables):
    return reconcile.reconcile(
        t.drifted_predictions, t.drifted_segments, t.drifted_recommendations, t.customers,
        check_only=True,
    ).report


@query("r04_update_in_place", "SELECT customer_id, main_risk_factor, TRUE AS others_kept FROM pred")
def r04_in_place(t: Tables):
    """Customers of one bucket have drifted: reconciling corrects them, and reads all other buckets from the files
    they were in.
    """
    store = ResultStore(t.spark, t.scratch("in_place"), t.buckets)
    one = part_of(t.buckets) == 0
    wrong = t.predictions.withColumn("main_risk_factor", F.when(one, "drifted").otherwise(F.col("main_risk_factor")))
    store.publish(store.create_job({}), wrong, t.segments, t.recommendations)
    files = F.input_file_name().alias("file")

    def places():
        return store.published()["predictions"].select(files, F.when(one, 0).otherwise(1).alias("other")).distinct()

    before = places().where("other = 1").select("file")
    reconcile.reconcile_results(store, t.customers)
    after = places()
    kept = (after.where("other = 1").join(before, "file", "left_anti").agg(F.count("*")).scalar() == 0) & (
        after.where("other = 0").agg(F.count_if(~F.col("file").contains("_amended_"))).scalar() == 0
    )
    return store.published()["predictions"].select("customer_id", "main_risk_factor", kept.alias("others_kept"))


def changes(df):
    return df.selectExpr("count(*) AS rows_count", "count_if(changed) AS changed_rows")


@query(
    "j07_join_update",
    """SELECT count(*) AS rows_count, count(*) FILTER (pred.main_risk_factor <> pred_d.main_risk_factor)
  AS changed_rows FROM pred_d JOIN pred USING (customer_id)""",
)
def j07(t: Tables):
    return changes(reconcile.reconcile_factors(t.drifted_predictions, t.customers))


@query(
    "j08_two_source_update",
    """SELECT count(*) AS rows_count, count(*) FILTER (s.segment_id <> x.segment_id) AS changed_rows
  FROM seg_d s JOIN seg x USING (customer_id)""",
)
def j08(t: Tables):
    return changes(reconcile.reconcile_segments(t.drifted_segments, t.predictions, t.customers))

