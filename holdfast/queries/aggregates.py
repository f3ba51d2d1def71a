"""Reports, joins and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdfast.functions import rules, screen, text
from holdfast.functions import labels as L
from holdfast.operators import customers, exports, filters, reports
from holdfast.queries.registry import query, rounded, six, sql_case
from holdfast.queries.tables import Tables

# Rows of the reports


def segment_rows(t: Tables):
    return t.predictions.join(t.segments, "customer_id")


def advised_rows(t: Tables):
    return t.predictions.join(t.recommendations, "customer_id")


def segment_cells(t: Tables):
    rows = segment_rows(t).join(t.recommendations, "customer_id", "left")
    return reports.cells(
        rows, "segment_id", "segment_name", "risk_group", "main_risk_factor", "recommendation_type"
    )


def advice_cells(t: Tables):
    return reports.cells(
        advised_rows(t), "recommendation_type", "recommendation_reason", "priority",
        "main_risk_factor", "risk_group",
    )


def top_sql(table: str, group: str, label: str, order: str = "") -> str:
    """The most frequent label of each group: count falling, ties by ``order`` and label."""
    return f"""SELECT {group}, {label} FROM (
      SELECT {group}, {label}, row_number() OVER (
        PARTITION BY {group} ORDER BY count(*) DESC, {order} {label}) AS place
      FROM {table} WHERE {label} IS NOT NULL GROUP BY {group}, {label}) ranked_labels WHERE place = 1"""


ACTIVE = "(SELECT * FROM facts WHERE recommendation_type <> 'No Action') active_rows"
MEMBERS = "(SELECT * FROM facts WHERE segment_name IS NOT NULL) member_rows"
FACTOR_ORDER = (
    "CASE main_risk_factor WHEN 'Customer service calls >= 3' THEN 1 WHEN 'High day charge' THEN 2 "
    "WHEN 'International plan' THEN 3 WHEN 'No voice mail plan' THEN 4 "
    "WHEN 'Stable customer profile' THEN 5 ELSE 6 END,"
)

# Aggregates


@query(
    "a01_key_figures",
    """SELECT count(*) AS total_customers, count(*) FILTER (risk_group = 'High') AS high_risk_customers,
       round(avg(churn_probability), 6) AS average_churn_probability,
       round(sum(churn_probability * estimated_total_charge), 6) AS estimated_revenue_at_risk,
       strftime(max(scoring_date), '%Y-%m-%d %H:%M:%S') AS last_scoring_date FROM pred""",
)
def a01(t: Tables):
    figures = reports.key_figures(reports.cells(t.predictions, "risk_group"))
    return rounded(figures, "average_churn_probability", "estimated_revenue_at_risk")


@query("a02_risk_distribution", "SELECT risk_group, count(*) AS customers_count FROM pred GROUP BY 1")
def a02(t: Tables):
    return reports.risk_distribution(reports.cells(t.predictions, "risk_group"))


@query(
    "a03_mean_probability_by_segment",
    """SELECT segment_name AS segment, round(avg(churn_probability), 6) AS average_churn_probability
       FROM pred JOIN seg USING (customer_id) GROUP BY 1""",
)
def a03(t: Tables):
    found = reports.mean_probability_by_segment(reports.cells(segment_rows(t), "segment_name"))
    return rounded(found, "average_churn_probability")


@query(
    "a04_high_risk_share_by_segment",
    """SELECT segment_name AS segment,
       round(count(*) FILTER (risk_group = 'High') / count(*), 6) AS high_risk_share
       FROM pred JOIN seg USING (customer_id) GROUP BY 1""",
)
def a04(t: Tables):
    rows = reports.cells(segment_rows(t), "segment_name", "risk_group")
    return rounded(reports.high_risk_share_by_segment(rows), "high_risk_share")


COUNTS_SQL = "SELECT recommendation_type, count(*) AS customers_count FROM pred JOIN rec USING (customer_id)"


def advice_counts(t: Tables):
    return reports.recommendation_counts(reports.cells(advised_rows(t), "recommendation_type"))


@query("a05_recommendation_counts", COUNTS_SQL + " GROUP BY 1")
def a05(t: Tables):
    return advice_counts(t)


@query(
    "a06_active_recommendation_counts",
    COUNTS_SQL + " WHERE recommendation_type <> 'No Action' GROUP BY 1",
)
def a06(t: Tables):
    rows = reports.cells(filters.active_only(advised_rows(t)), "recommendation_type")
    return reports.recommendation_counts(rows)


TOP_FACTORS_SQL = """SELECT main_risk_factor AS factor, count(*) AS customers_count,
  round(count(*) / (SELECT count(*) FROM pred WHERE risk_group = 'High'), 6) AS high_risk_share,
  CASE WHEN count(*) / (SELECT count(*) FROM pred WHERE risk_group = 'High') >= 0.25 THEN 'High'
       WHEN count(*) / (SELECT count(*) FROM pred WHERE risk_group = 'High') >= 0.05 THEN 'Medium'
       ELSE 'Low' END AS impact
  FROM pred WHERE risk_group = 'High' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"""


@query("a07_top_risk_factors", TOP_FACTORS_SQL)
def a07(t: Tables):
    rows = reports.cells(t.predictions, "risk_group", "main_risk_factor")
    return rounded(reports.top_risk_factors(rows), "high_risk_share")


PRIORITY_SQL = f"""SELECT segment_name AS segment, count(*) AS clients_count,
  round(avg(churn_probability), 6) AS average_churn_probability,
  round(count(*) FILTER (risk_group = 'High') / count(*), 6) AS high_risk_share,
  any_value(f.main_risk_factor) AS main_risk_factor,
  any_value(r.recommendation_type) AS main_recommendation
  FROM {MEMBERS}
  LEFT JOIN ({top_sql(MEMBERS, 'segment_name', 'main_risk_factor')}) f USING (segment_name)
  LEFT JOIN ({top_sql(MEMBERS, 'segment_name', 'recommendation_type')}) r USING (segment_name)
  GROUP BY segment_name ORDER BY avg(churn_probability) DESC, segment_name LIMIT 3"""


@query("a08_priority_segments", PRIORITY_SQL)
def a08(t: Tables):
    return rounded(
        reports.priority_segments(segment_cells(t)), "average_churn_probability", "high_risk_share"
    )


def summary_sql(key: str) -> str:
    return f"""(SELECT {key}, clients_count, high_risk_customers, average_churn_probability,
  high_risk_customers / clients_count AS high_risk_share, average_estimated_total_charge,
  coalesce(r.recommendation_type, 'No Action') AS main_recommendation,
  CASE segment_name WHEN 'Service Issue Segment' THEN 'Customer service calls >= 3'
    WHEN 'Tariff Optimization Segment' THEN 'High day charge'
    WHEN 'International Usage Segment' THEN 'International plan'
    WHEN 'Stable Customer Segment' THEN 'Stable customer profile'
    ELSE 'no other segment occurs' END AS main_risk_factor
  FROM (SELECT {key}, count(*) AS clients_count, count(*) FILTER (risk_group = 'High') AS high_risk_customers,
          avg(churn_probability) AS average_churn_probability,
          avg(estimated_total_charge) AS average_estimated_total_charge
        FROM pred JOIN seg USING (customer_id) GROUP BY {key}) s
  LEFT JOIN ({top_sql(ACTIVE, key, 'recommendation_type')}) r USING ({key})) summary"""


SUMMARY = summary_sql("segment_id, segment_name")
SUMMARY_COLUMNS = """clients_count, high_risk_customers,
  round(average_churn_probability, 6) AS average_churn_probability,
  round(high_risk_share, 6) AS high_risk_share,
  round(average_estimated_total_charge, 6) AS average_estimated_total_charge,
  main_recommendation, main_risk_factor"""
SUMMARY_DOUBLES = ("average_churn_probability", "high_risk_share", "average_estimated_total_charge")


@query("a09_segment_summary", f"SELECT segment_id, segment_name, {SUMMARY_COLUMNS} FROM {SUMMARY}")
def a09(t: Tables):
    return rounded(reports.segment_summary(segment_cells(t)), *SUMMARY_DOUBLES)


def decimal_sql(value: str, digits: int = 2) -> str:
    return f"replace(format('{{:.{digits}f}}', {value}), '.', ',')"


@query(
    "a10_segment_summary_export",
    f"""SELECT {sql_case('segment_name', L.SEGMENT_TEXT)} AS "Сегмент", clients_count AS "Клиенты",
  {decimal_sql('round(average_churn_probability, 9)')} AS "Средняя вероятность оттока",
  high_risk_customers AS "Клиенты высокого риска",
  CAST(CAST(round_even(high_risk_share * 100, 0) AS BIGINT) AS VARCHAR) || '%' AS "Доля высокого риска",
  {decimal_sql('round(average_estimated_total_charge, 9)')} AS "Средние расходы",
  {sql_case('main_recommendation', L.ACTION_TEXT)} AS "Основное действие",
  {sql_case('main_risk_factor', L.FACTOR_TEXT)} AS "Основной фактор риска"
  FROM {summary_sql('segment_name')}""",
)
def a10(t: Tables):
    return exports.segments_export(segment_cells(t))


PLAN_SQL = f"""(SELECT recommendation_type, count(*) AS customers_count,
  count(*) FILTER (risk_group = 'High') AS high_risk_customers,
  count(*) FILTER (active_rows.priority = 'High') AS high_priority_customers,
  avg(churn_probability) AS average_churn_probability,
  count(*) FILTER (risk_group = 'High') / count(*) AS high_risk_share,
  sum(churn_probability * estimated_total_charge) AS estimated_revenue_at_risk,
  any_value(a.recommendation_reason) AS recommendation_reason, any_value(b.priority) AS priority,
  any_value(c.main_risk_factor) AS main_risk_factor
  FROM {ACTIVE}
  LEFT JOIN ({top_sql(ACTIVE, 'recommendation_type', 'recommendation_reason')}) a USING (recommendation_type)
  LEFT JOIN ({top_sql(ACTIVE, 'recommendation_type', 'priority')}) b USING (recommendation_type)
  LEFT JOIN ({top_sql(ACTIVE, 'recommendation_type', 'main_risk_factor')}) c USING (recommendation_type)
  GROUP BY recommendation_type) plan"""


@query(
    "a11_recommendation_plan",
    f"""SELECT recommendation_type, customers_count, high_risk_customers, high_priority_customers,
  round(average_churn_probability, 6) AS average_churn_probability,
  round(high_risk_share, 6) AS high_risk_share,
  round(estimated_revenue_at_risk, 6) AS estimated_revenue_at_risk,
  recommendation_reason, priority, main_risk_factor FROM {PLAN_SQL}""",
)
def a11(t: Tables):
    return rounded(
        reports.recommendation_plan(advice_cells(t)),
        "average_churn_probability", "high_risk_share", "estimated_revenue_at_risk",
    )


@query(
    "a12_recommendation_plan_export",
    f"""SELECT {sql_case('recommendation_type', L.ACTION_TEXT)} AS "Рекомендация",
  customers_count AS "Клиенты", high_risk_customers AS "Клиенты высокого риска",
  {decimal_sql('round(average_churn_probability, 9)')} AS "Средняя вероятность оттока",
  {decimal_sql('round(estimated_revenue_at_risk, 9)')} AS "Выручка под риском",
  {sql_case('priority', L.PRIORITY_TEXT)} AS "Приоритет",
  {sql_case('recommendation_reason', L.REASON_TEXT)} AS "Причина рекомендации",
  {sql_case('main_risk_factor', L.FACTOR_TEXT)} AS "Основной фактор риска" FROM {PLAN_SQL}""",
)
def a12(t: Tables):
    return exports.recommendations_export(advice_cells(t))


@query(
    "a13_conditional_counts",
    """SELECT recommendation_type, count(*) FILTER (risk_group = 'High') AS high_risk_customers,
  count(*) FILTER (priority = 'High') AS high_priority_customers
  FROM pred JOIN rec USING (customer_id) GROUP BY 1""",
)
def a13(t: Tables):
    return advised_rows(t).groupBy("recommendation_type").agg(
        F.count_if(F.col("risk_group") == "High").alias("high_risk_customers"),
        F.count_if(F.col("priority") == "High").alias("high_priority_customers"),
    )


@query(
    "a14_most_frequent_factor",
    f"SELECT * FROM ({top_sql(MEMBERS, 'segment_name', 'main_risk_factor')}) modes",
)
def a14(t: Tables):
    rows = reports.cells(segment_rows(t), "segment_name", "main_risk_factor")
    counted = reports.with_label_counts(rows, ["segment_name"], ["main_risk_factor"])
    return counted.groupBy("segment_name").agg(reports.most_frequent("main_risk_factor"))


@query(
    "a15_filter_options",
    """SELECT DISTINCT 'risk_groups' AS option_list, risk_group AS option_value FROM pred
  UNION ALL SELECT DISTINCT 'segments', segment_name FROM seg
  UNION ALL SELECT DISTINCT 'recommendations', recommendation_type FROM rec
  UNION ALL SELECT DISTINCT 'main_risk_factors', main_risk_factor FROM pred""",
)
def a15(t: Tables):
    stacked = None
    for name, values in customers.filter_options(*t.result_tables).items():
        part = values.select(F.lit(name).alias("option_list"), F.col(values.columns[0]).alias("option_value"))
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked


@query(
    "a16_portfolio_mean",
    """SELECT round(avg(churn_probability), 6) AS portfolio_average_risk
  FROM pred JOIN seg USING (customer_id)""",
)
def a16(t: Tables):
    summary = reports.segment_summary(segment_cells(t))
    return rounded(reports.portfolio_mean(summary), "portfolio_average_risk")


@query(
    "a17_active_total",
    """SELECT count(*) AS active_recommendations FROM pred JOIN rec USING (customer_id)
  WHERE recommendation_type <> 'No Action'""",
)
def a17(t: Tables):
    return reports.active_total(advice_counts(t))


# Joins


@query(
    "j01_result_rows",
    """SELECT customer_id, churn_probability, segment_name, recommendation_type, priority FROM facts""",
)
def j01(t: Tables):
    return customers.result_rows(*t.result_tables).select(
        "customer_id", "churn_probability", "segment_name", "recommendation_type", "priority"
    )


@query(
    "j02_inner_join",
    "SELECT customer_id, risk_group, recommendation_type FROM pred JOIN rec USING (customer_id)",
)
def j02(t: Tables):
    return advised_rows(t).select("customer_id", "risk_group", "recommendation_type")


@query(
    "j03_inner_then_left",
    """SELECT customer_id, risk_group, segment_name, recommendation_type
  FROM seg JOIN pred USING (customer_id) LEFT JOIN rec USING (customer_id)""",
)
def j03(t: Tables):
    joined = t.segments.join(t.predictions, "customer_id").join(t.recommendations, "customer_id", "left")
    return joined.select("customer_id", "risk_group", "segment_name", "recommendation_type")


@query(
    "j04_three_way_inner",
    """SELECT customer_id, risk_group, segment_name, recommendation_type
  FROM seg JOIN pred USING (customer_id) JOIN rec USING (customer_id)""",
)
def j04(t: Tables):
    joined = t.segments.join(t.recommendations, "customer_id").join(t.predictions, "customer_id")
    return joined.select("customer_id", "risk_group", "segment_name", "recommendation_type")


@query(
    "j05_left_join_with_right_condition",
    """SELECT segment_name, recommendation_type, count(*) AS recommendation_count
  FROM seg LEFT JOIN rec USING (customer_id) JOIN pred USING (customer_id)
  WHERE recommendation_type <> 'No Action' GROUP BY 1, 2""",
)
def j05(t: Tables):
    joined = t.segments.join(filters.active_only(t.recommendations), "customer_id").join(
        t.predictions, "customer_id", "left_semi"
    )
    return joined.groupBy("segment_name", "recommendation_type").agg(
        F.count("*").alias("recommendation_count")
    )


FACTOR_TOP = top_sql(
    "(SELECT * FROM facts WHERE segment_name IS NOT NULL "
    "AND main_risk_factor <> 'Stable customer profile') named_rows",
    "segment_id, segment_name", "main_risk_factor", FACTOR_ORDER,
)


@query(
    "j06_top_one_join",
    f"""SELECT segment_id, segment_name, clients_count, recommendation_type, main_risk_factor
  FROM (SELECT segment_id, segment_name, count(*) AS clients_count FROM pred JOIN seg USING (customer_id)
        GROUP BY 1, 2) s
  LEFT JOIN ({top_sql(ACTIVE, 'segment_id, segment_name', 'recommendation_type')}) r
    USING (segment_id, segment_name)
  LEFT JOIN ({FACTOR_TOP}) f USING (segment_id, segment_name)""",
)
def j06(t: Tables):
    rows, key = segment_cells(t), ["segment_id", "segment_name"]
    merged = reports.with_leaders(reports.segment_stats(rows, key), rows, key)
    return merged.select(*key, "clients_count", "recommendation_type", "main_risk_factor")


# Windows over aggregates


@query(
    "w02_recommendation_ranks",
    """SELECT segment_id, segment_name, recommendation_type, count(*) AS recommendation_count,
  CAST(row_number() OVER (PARTITION BY segment_id, segment_name
    ORDER BY count(*) DESC, recommendation_type) AS INTEGER) AS row_number
  FROM facts WHERE segment_name IS NOT NULL AND recommendation_type <> 'No Action' GROUP BY 1, 2, 3""",
)
def w02(t: Tables):
    return reports.recommendation_ranks(segment_cells(t), ["segment_id", "segment_name"])


@query(
    "w03_factor_ranks",
    f"""SELECT segment_id, segment_name, main_risk_factor, count(*) AS factor_count,
  CAST(row_number() OVER (PARTITION BY segment_id, segment_name
    ORDER BY count(*) DESC, {FACTOR_ORDER} main_risk_factor) AS INTEGER) AS row_number
  FROM facts WHERE segment_name IS NOT NULL AND main_risk_factor <> 'Stable customer profile'
  GROUP BY 1, 2, 3""",
)
def w03(t: Tables):
    return reports.factor_ranks(segment_cells(t), ["segment_id", "segment_name"])


@query(
    "w04_share_of_total",
    """SELECT main_risk_factor, count(*) AS customers_count,
  CAST(sum(count(*)) OVER () AS BIGINT) AS total_customers,
  round(count(*) / sum(count(*)) OVER (), 6) AS share FROM pred GROUP BY 1""",
)
def w04(t: Tables):
    found = t.predictions.groupBy("main_risk_factor").agg(F.count("*").alias("customers_count"))
    return reports.with_total(found, "customers_count", "total_customers").withColumn(
        "share", six(F.col("customers_count") / F.col("total_customers"))
    )


# Top-k, scoring jobs


@query("l02_top_five_factors", TOP_FACTORS_SQL)
def l02(t: Tables):
    return a07(t)


LATEST = """(SELECT * FROM jobs WHERE status = 'success' {extra}
  ORDER BY scoring_date DESC NULLS FIRST, id DESC LIMIT 1)"""


@query(
    "l03_latest_success",
    "SELECT id, model_version, strftime(scoring_date, '%Y-%m-%d %H:%M:%S') AS scoring_date FROM "
    + LATEST.format(extra=""),
)
def l03(t: Tables):
    return reports.latest_success(t.jobs).select(
        "id", "model_version", text.timestamp_text(F.col("scoring_date")).alias("scoring_date")
    )


SCORING_INFO_SQL = f"""SELECT j.model_name, j.model_version, j.algorithm, m.roc_auc, m.f1_score, m.recall,
  coalesce(j.high_risk_threshold, 0.7) AS high_risk_threshold,
  coalesce(j.medium_risk_threshold, 0.35) AS medium_risk_threshold,
  strftime(j.scoring_date, '%Y-%m-%d %H:%M:%S') AS last_scoring_date,
  strftime(m.scoring_date, '%Y-%m-%d %H:%M:%S') AS last_training_date
  FROM {LATEST.format(extra='')} j LEFT JOIN
  {LATEST.format(extra='AND roc_auc IS NOT NULL AND f1_score IS NOT NULL AND recall IS NOT NULL')} m ON TRUE"""


@query("l04_scoring_info", SCORING_INFO_SQL)
def l04(t: Tables):
    return reports.scoring_info(t.jobs)


@query(
    "l05_risk_group_order",
    """SELECT risk_group, count(*) AS customers_count,
  CAST(CASE risk_group WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 3 ELSE 4 END AS INTEGER)
    AS place FROM pred GROUP BY 1""",
)
def l05(t: Tables):
    found = reports.risk_distribution(reports.cells(t.predictions, "risk_group"))
    return found.withColumn("place", rules.risk_rank(F.col("risk_group"))).orderBy("place", "risk_group")


TOP_ACTIONS_SQL = (
    COUNTS_SQL + " WHERE recommendation_type <> 'No Action' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT "
)


@query("l06_top_four_actions", TOP_ACTIONS_SQL + "4")
def l06(t: Tables):
    return reports.top_actions(advice_counts(t), 4)


@query(
    "l06_top_five_plan_items",
    f"""SELECT recommendation_type, customers_count FROM {PLAN_SQL}
  ORDER BY estimated_revenue_at_risk DESC, recommendation_type LIMIT 5""",
)
def l06_plan(t: Tables):
    plan = reports.recommendation_plan(advice_cells(t)).limit(5)
    return plan.select("recommendation_type", "customers_count")


# Stacked outputs

UNION_CELLS = f"""SELECT 'KPI' AS "Раздел", 'Всего клиентов' AS "Показатель",
  CAST(count(*) AS VARCHAR) AS "Значение" FROM pred
  UNION ALL SELECT 'KPI', 'Клиенты высокого риска', CAST(count(*) AS VARCHAR) FROM pred WHERE risk_group = 'High'
  UNION ALL SELECT 'KPI', 'Средняя вероятность оттока', {decimal_sql('round(avg(churn_probability), 9)', 4)} FROM pred
  UNION ALL SELECT 'KPI', 'Выручка под риском',
    {decimal_sql('round(sum(churn_probability * estimated_total_charge), 9)')} FROM pred
  UNION ALL SELECT 'KPI', 'Дата последнего прогноза', strftime(max(scoring_date), '%Y-%m-%d %H:%M:%S') FROM pred
  UNION ALL SELECT 'Распределение риска', {sql_case('risk_group', L.RISK_GROUP_TEXT)}, CAST(count(*) AS VARCHAR)
    FROM pred GROUP BY risk_group
  UNION ALL SELECT 'Сводка рекомендаций', {sql_case('recommendation_type', L.ACTION_TEXT)}, CAST(count(*) AS VARCHAR)
    FROM rec WHERE recommendation_type <> 'No Action' GROUP BY recommendation_type"""


@query("u01_dashboard_export", UNION_CELLS)
def u01(t: Tables):
    return exports.dashboard_export(*t.result_tables)


@query(
    "u02_dashboard_sections",
    f"""SELECT 'kpis' AS section, 'total' AS label, CAST(count(*) AS DOUBLE) AS value FROM pred
  UNION ALL SELECT 'kpis', 'revenue', round(sum(churn_probability * estimated_total_charge), 6) FROM pred
  UNION ALL SELECT 'risk_distribution', risk_group, CAST(count(*) AS DOUBLE) FROM pred GROUP BY 2
  UNION ALL SELECT 'average_churn_by_segment', segment_name, round(avg(churn_probability), 6)
    FROM facts WHERE segment_name IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'high_risk_share_by_segment', segment_name,
    round(count(*) FILTER (risk_group = 'High') / count(*), 6)
    FROM facts WHERE segment_name IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'recommendations_summary', recommendation_type, CAST(count(*) AS DOUBLE) FROM rec GROUP BY 2
  UNION ALL SELECT 'top_risk_factors', factor, CAST(customers_count AS DOUBLE) FROM ({TOP_FACTORS_SQL}) top_factors
  UNION ALL SELECT 'priority_segments', segment || '/' || main_risk_factor || '/' || main_recommendation,
    CAST(clients_count AS DOUBLE) FROM ({PRIORITY_SQL}) priority_rows
  UNION ALL SELECT 'scoring_info', last_scoring_date, roc_auc FROM ({SCORING_INFO_SQL}) info""",
)
def u02(t: Tables):
    parts = reports.dashboard_summary(*t.result_tables, t.jobs)
    figures = parts["kpis"]
    shown = {
        "risk_distribution": ("risk_group", "customers_count"),
        "average_churn_by_segment": ("segment", "average_churn_probability"),
        "high_risk_share_by_segment": ("segment", "high_risk_share"),
        "recommendations_summary": ("recommendation_type", "customers_count"),
        "top_risk_factors": ("factor", "customers_count"),
        "scoring_info": ("last_scoring_date", "roc_auc"),
    }

    def lines(section, df, label, value):
        return df.select(
            F.lit(section).alias("section"), label.alias("label"), six(value.cast("double")).alias("value")
        )

    stacked = lines("kpis", figures, F.lit("total"), F.col("total_customers")).unionByName(
        lines("kpis", figures, F.lit("revenue"), F.col("estimated_revenue_at_risk"))
    )
    for section, (label, value) in shown.items():
        stacked = stacked.unionByName(lines(section, parts[section], F.col(label), F.col(value)))
    label = F.concat_ws("/", "segment", "main_risk_factor", "main_recommendation")
    return stacked.unionByName(
        lines("priority_segments", parts["priority_segments"], label, F.col("clients_count"))
    )


# Expressions over report rows

PROFILE_SQL = f"""(SELECT *, (SELECT avg(churn_probability) FROM facts WHERE segment_name IS NOT NULL) AS overall
  FROM {SUMMARY}) profile"""


@query(
    "f22_segment_factor",
    """SELECT customer_id, CASE
    WHEN segment_id IN (1, 3) AND segment_name = 'Service Issue Segment' THEN 'Customer service calls >= 3'
    WHEN segment_id IN (1, 3) AND segment_name = 'International Usage Segment' THEN 'International plan'
    WHEN recommendation_type = 'Service Recovery Call' THEN 'Customer service calls >= 3'
    WHEN recommendation_type = 'Tariff Optimization' THEN 'High day charge'
    WHEN recommendation_type = 'International Plan Review' THEN 'International plan'
    WHEN recommendation_type = 'Voice Mail Offer' THEN 'No voice mail plan'
    ELSE coalesce(main_risk_factor, 'Stable customer profile') END AS segment_factor FROM facts""",
)
def f22(t: Tables):
    name = F.when(F.col("segment_id").isin(1, 3), F.col("segment_name"))
    factor = rules.segment_factor(name, F.col("recommendation_type"), F.col("main_risk_factor"))
    return customers.result_rows(*t.result_tables).select("customer_id", factor.alias("segment_factor"))


@query(
    "f24_impact",
    """SELECT main_risk_factor AS factor, CASE WHEN count(*) / (SELECT count(*) FROM pred) >= 0.25 THEN 'High'
  WHEN count(*) / (SELECT count(*) FROM pred) >= 0.05 THEN 'Medium' ELSE 'Low' END AS impact
  FROM pred GROUP BY 1""",
)
def f24(t: Tables):
    return w04(t).select(
        F.col("main_risk_factor").alias("factor"),
        rules.impact(F.col("customers_count") / F.col("total_customers")).alias("impact"),
    )


@query(
    "f25_attention_level",
    f"""SELECT segment_name, CASE
  WHEN average_churn_probability >= 0.7 OR high_risk_share >= 0.5 OR high_risk_customers >= 10
    THEN 'Критический приоритет'
  WHEN average_churn_probability >= 0.35 OR high_risk_share >= 0.15 OR high_risk_customers >= 3
    THEN 'Требует внимания' ELSE 'Стабильный сегмент' END AS attention_label,
  CASE WHEN average_churn_probability >= 0.7 OR high_risk_share >= 0.5 OR high_risk_customers >= 10 THEN 'red'
  WHEN average_churn_probability >= 0.35 OR high_risk_share >= 0.15 OR high_risk_customers >= 3 THEN 'amber'
  ELSE 'green' END AS attention_tone FROM {PROFILE_SQL}""",
)
def f25(t: Tables):
    profiles = reports.segment_profiles(reports.segment_summary(segment_cells(t)))
    return profiles.select("segment_name", "attention_label", "attention_tone")


@query(
    "f26_difference_to_portfolio",
    f"""SELECT segment_name,
  CAST(floor(abs(average_churn_probability - overall) * 100 + 0.5) AS INTEGER) AS difference_points,
  CASE WHEN floor(abs(average_churn_probability - overall) * 100 + 0.5) = 0 THEN 'level'
       WHEN average_churn_probability > overall THEN 'above' ELSE 'below' END AS difference_direction
  FROM {PROFILE_SQL}""",
)
def f26(t: Tables):
    profiles = reports.segment_profiles(reports.segment_summary(segment_cells(t)))
    return profiles.select("segment_name", "difference_points", "difference_direction")


@query(
    "f27_tones",
    """SELECT customer_id, CASE WHEN churn_probability < 0.35 THEN 'green'
  WHEN churn_probability < 0.7 THEN 'amber' ELSE 'red' END AS probability_tone,
  CASE WHEN churn_probability < 0.15 THEN 'green' WHEN churn_probability < 0.5 THEN 'amber'
  ELSE 'red' END AS share_tone FROM pred""",
)
def f27(t: Tables):
    p = F.col("churn_probability")
    return t.predictions.select(
        "customer_id",
        screen.probability_tone(p).alias("probability_tone"),
        screen.share_tone(p).alias("share_tone"),
    )
