"""Rules, health, text and other expressions over all customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdfast.functions import health, rules, text
from holdfast.functions import labels as L
from holdfast.functions.numbers import clamp
from holdfast.operators import customers, features, scoring
from holdfast.queries.aggregates import decimal_sql
from holdfast.queries.customer_pages import (
    LONG_SCORE,
    POTENTIAL_SQL,
    PROCESSING_SQL,
    SCORE,
    drivers_sql,
    driver_text,
    status_sql,
)
from holdfast.queries.registry import query, sql_case, sql_text
from holdfast.queries.tables import Tables


def facts(t: Tables):
    return customers.result_rows(*t.result_tables)


@query("f01_plan_text", "SELECT customer_id, international_plan, voice_mail_plan FROM prepared")
def f01(t: Tables):
    plans = t.customers.select("customer_id", "international_plan", "voice_mail_plan")
    return features.normalize_plans(plans)


@query("f02_estimated_total_charge", "SELECT customer_id, estimated_total_charge FROM prepared")
def f02(t: Tables):
    return features.add_estimated_total_charge(t.customers).select("customer_id", "estimated_total_charge")


@query("f05_risk_group", "SELECT customer_id, risk_group FROM scored")
def f05(t: Tables):
    return t.inputs.select("customer_id", rules.risk_group(F.col("churn_probability")).alias("risk_group"))


@query(
    "f06_main_risk_factor",
    """SELECT customer_id, main_risk_factor AS exact_text, CASE
  WHEN customer_service_calls >= 3 THEN 'Customer service calls >= 3'
  WHEN total_day_charge >= 40 THEN 'High day charge'
  WHEN voice_mail_plan = 'no' THEN 'No voice mail plan'
  ELSE 'Stable customer profile' END AS padded_text, main_risk_factor AS trimmed_text FROM scored""",
)
def f06(t: Tables):
    """Padded plan text counts for reconciliation, which trims, but not for scoring."""
    padded = F.concat(F.lit(" "), F.col("international_plan"), F.lit(" "))

    def factor(plan, trim):
        return rules.main_risk_factor(
            F.col("customer_service_calls"), F.col("total_day_charge"), plan,
            F.col("voice_mail_plan"), trim,
        )

    return t.customers.select(
        "customer_id",
        factor(F.col("international_plan"), "none").alias("exact_text"),
        factor(padded, "none").alias("padded_text"),
        factor(padded, "spaces").alias("trimmed_text"),
    )


@query(
    "f07_says_yes",
    """SELECT customer_id, international_plan = 'yes' AS exact_text, international_plan = 'yes' AS padded_text
  FROM prepared""",
)
def f07(t: Tables):
    plan = F.col("international_plan")
    return t.customers.select(
        "customer_id",
        rules.says_yes(plan).alias("exact_text"),
        rules.says_yes(F.concat(F.lit("\t"), plan, F.lit(" \n"))).alias("padded_text"),
    )


@query(
    "f08_segment",
    "SELECT customer_id, rule_segment_id AS segment_id, rule_segment_name AS segment_name FROM ruled",
)
def f08(t: Tables):
    return scoring.customer_segments(features.prepare_features(t.inputs))


@query("f09_priority", "SELECT customer_id, base_priority AS priority FROM ruled")
def f09(t: Tables):
    return t.predictions.select(
        "customer_id",
        rules.priority(F.col("churn_probability"), F.col("estimated_total_charge")).alias("priority"),
    )


@query(
    "f10_recommendation",
    """SELECT customer_id, rule_type AS recommendation_type, rule_reason AS recommendation_reason,
  rule_priority AS priority FROM ruled""",
)
def f10(t: Tables):
    return scoring.customer_recommendations(t.predictions)


@query(
    "f11_revenue_at_risk",
    """SELECT customer_id, CAST(format('{:.2f}', churn_probability * estimated_total_charge) AS DOUBLE)
  AS revenue_at_risk FROM pred""",
)
def f11(t: Tables):
    revenue = health.revenue_at_risk(F.col("churn_probability"), F.col("estimated_total_charge"))
    return t.predictions.select("customer_id", revenue.alias("revenue_at_risk"))


@query(
    "f12_clamp",
    "SELECT customer_id, greatest(40.0::DOUBLE, least(65.5::DOUBLE, estimated_total_charge)) AS clamped FROM pred",
)
def f12(t: Tables):
    return t.predictions.select(
        "customer_id", clamp(F.col("estimated_total_charge"), 40.0, 65.5).alias("clamped")
    )


@query("f13_health_score", f"SELECT customer_id, {SCORE} AS health_score FROM pred")
def f13(t: Tables):
    score = health.health_score(
        F.col("churn_probability"), F.col("risk_group"), F.col("main_risk_factor"),
        F.col("estimated_total_charge"),
    )
    return t.predictions.select("customer_id", score.alias("health_score"))


@query(
    "f14_health_status",
    f"""SELECT customer_id, {status_sql('health_score', 1)} AS code, {status_sql('health_score', 2)} AS label,
  {status_sql('health_score', 3)} AS tone
  FROM (SELECT customer_id, {LONG_SCORE.format(p='(churn_probability * 1.4)')} AS health_score FROM pred) scores""",
)
def f14(t: Tables):
    """Probabilities are stretched so that all four states occur."""
    score = health.health_score(
        F.col("churn_probability") * 1.4, F.col("risk_group"), F.col("main_risk_factor"),
        F.col("estimated_total_charge"),
    )
    return t.predictions.select("customer_id", health.health_status(score).alias("s")).select(
        "customer_id", "s.*"
    )


@query(
    "f15_processing_priority",
    f"""SELECT customer_id, {PROCESSING_SQL} AS from_english, {PROCESSING_SQL} AS from_russian,
  CAST(CASE risk_group WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END AS INTEGER) AS from_group FROM facts""",
)
def f15(t: Tables):
    group, priority = F.col("risk_group"), F.col("priority")
    russian = text.translated(priority, L.PRIORITY_TEXT)
    return facts(t).select(
        "customer_id",
        health.processing_priority(group, priority).alias("from_english"),
        health.processing_priority(group, russian).alias("from_russian"),
        health.processing_priority(group, F.lit(None).cast("string")).alias("from_group"),
    )


@query("f17_reduction_potential", f"SELECT customer_id, {POTENTIAL_SQL} AS reduction_potential FROM facts")
def f17(t: Tables):
    potential = health.reduction_potential(F.col("risk_group"), F.col("recommendation_type"))
    return facts(t).select("customer_id", potential.alias("reduction_potential"))


@query("f18_risk_drivers", f"SELECT customer_id, {drivers_sql()} AS risk_drivers FROM facts")
def f18(t: Tables):
    names = ("churn_probability", "main_risk_factor", "estimated_total_charge", "segment_name",
             "recommendation_type")
    drivers = health.risk_drivers(*[F.col(n) for n in names])
    return facts(t).select("customer_id", driver_text(drivers).alias("risk_drivers"))


@query(
    "f19_decimal_and_share_text",
    f"""SELECT customer_id, {decimal_sql('churn_probability * estimated_total_charge')} AS revenue_text,
  {decimal_sql('churn_probability', 4)} AS probability_text,
  CAST(CAST(round_even(churn_probability * 100, 0) AS BIGINT) AS VARCHAR) || '%' AS share_text FROM pred""",
)
def f19(t: Tables):
    p = F.col("churn_probability")
    return t.predictions.select(
        "customer_id",
        text.decimal_text(p * F.col("estimated_total_charge")).alias("revenue_text"),
        text.decimal_text(p, 4).alias("probability_text"),
        text.percent_text(p).alias("share_text"),
    )


@query(
    "f20_date_text",
    """SELECT customer_id, coalesce(strftime(scoring_date, '%d.%m.%Y'), '') AS day_text,
  coalesce(strftime(scoring_date, '%d.%m.%Y'), '') AS day_text_of_text,
  CASE WHEN scoring_date IS NULL THEN '-' ELSE strftime(scoring_date, '%Y-%m-%d %H:%M') END AS minute_text,
  'no date' AS unparsable_day, 'no date' AS unparsable_minute FROM pred""",
)
def f20(t: Tables):
    moment = F.col("scoring_date")
    written = text.timestamp_text(moment)
    broken = F.when(F.length("customer_id") > 0, "no date")
    return t.predictions.select(
        "customer_id",
        text.day_text(moment).alias("day_text"),
        text.day_text(written, is_text=True).alias("day_text_of_text"),
        text.minute_text(written).alias("minute_text"),
        text.day_text(broken, is_text=True).alias("unparsable_day"),
        text.minute_text(F.concat(broken, F.lit(".x"))).alias("unparsable_minute"),
    )


def screen_sql(column: str, entries: dict[str, str]) -> str:
    return f"CASE WHEN coalesce({column}, '') = '' THEN '-' ELSE {sql_case(column, entries)} END"


@query(
    "f21_label_text",
    f"""SELECT customer_id, {sql_case('segment_name', L.SEGMENT_TEXT)} AS export_segment,
  {screen_sql('segment_name', L.SCREEN_SEGMENT_TEXT)} AS screen_segment,
  {screen_sql('main_risk_factor', L.SCREEN_FACTOR_TEXT)} AS screen_factor,
  {screen_sql('recommendation_type', L.ACTION_TEXT)} AS screen_action,
  {screen_sql('risk_group', L.RISK_GROUP_TEXT)} AS screen_group,
  {screen_sql('priority', L.PRIORITY_TEXT)} AS screen_priority FROM facts""",
)
def f21(t: Tables):
    return facts(t).select(
        "customer_id",
        text.translated(F.col("segment_name"), L.SEGMENT_TEXT).alias("export_segment"),
        text.screen_text(F.col("segment_name"), L.SCREEN_SEGMENT_TEXT).alias("screen_segment"),
        text.screen_text(F.col("main_risk_factor"), L.SCREEN_FACTOR_TEXT).alias("screen_factor"),
        text.screen_text(F.col("recommendation_type"), L.ACTION_TEXT).alias("screen_action"),
        text.screen_group_text(F.col("risk_group"), L.RISK_GROUP_TEXT).alias("screen_group"),
        text.screen_group_text(F.col("priority"), L.PRIORITY_TEXT).alias("screen_priority"),
    )


def phrase_sql(column: str) -> str:
    whens = []
    for phrases, shown in L.REASON_PHRASES:
        hits = " OR ".join(f"contains(lower({column}), {sql_text(p)})" for p in phrases)
        whens.append(f"WHEN {hits} THEN {sql_text(shown)}")
    return f"CASE {' '.join(whens)} ELSE {column} END"


@query(
    "f23_reason_text",
    f"""SELECT customer_id, {screen_sql('recommendation_reason', L.SCREEN_REASON_TEXT)} AS exact_reason,
  CASE WHEN recommendation_reason IS NULL THEN '-' ELSE {phrase_sql("recommendation_reason")} END AS reworded,
  {phrase_sql("main_risk_factor")} AS from_factor FROM facts""",
)
def f23(t: Tables):
    reason = F.col("recommendation_reason")
    return facts(t).select(
        "customer_id",
        text.reason_text(reason).alias("exact_reason"),
        text.reason_text(F.upper(reason)).alias("reworded"),
        text.reason_text(F.col("main_risk_factor")).alias("from_factor"),
    )


@query(
    "f28_short_action_text",
    f"""SELECT customer_id, {screen_sql('recommendation_type', {**L.ACTION_TEXT, **L.SHORT_ACTION_TEXT})}
  AS short_action FROM facts""",
)
def f28(t: Tables):
    return facts(t).select(
        "customer_id", text.short_action_text(F.col("recommendation_type")).alias("short_action")
    )


PREPARED_COLUMNS = "customer_id, state, international_plan, voice_mail_plan, total_day_minutes, estimated_total_charge"


@query("m01_prepared_features", f"SELECT {PREPARED_COLUMNS} FROM prepared")
def m01(t: Tables):
    return features.prepare_features(t.customers).select(*PREPARED_COLUMNS.split(", "))


@query("m05_enriched_predictions", "SELECT customer_id, risk_group, main_risk_factor FROM scored")
def m05(t: Tables):
    return t.scored.select("customer_id", "risk_group", "main_risk_factor")


@query(
    "m06_customer_segments",
    "SELECT customer_id, rule_segment_id AS segment_id, rule_segment_name AS segment_name FROM ruled",
)
def m06(t: Tables):
    return scoring.customer_segments(t.scored)


@query(
    "m07_customer_recommendations",
    """SELECT customer_id, rule_type AS recommendation_type, rule_reason AS recommendation_reason,
  rule_priority AS priority FROM ruled""",
)
def m07(t: Tables):
    return scoring.customer_recommendations(t.scored)
