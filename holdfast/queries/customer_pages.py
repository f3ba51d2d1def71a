"""Customer lists, filters and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdfast.functions import labels as L
from holdfast.operators import customers, exports, filters
from holdfast.operators.filters import CustomerFilter
from holdfast.queries.aggregates import decimal_sql
from holdfast.queries.registry import query, sql_case
from holdfast.queries.tables import Tables

LONG_SCORE = """CAST(round_even(greatest(0, least(100, 100 - {p} * 70
  - CASE risk_group WHEN 'High' THEN 8 WHEN 'Medium' THEN 4 ELSE 0 END
  - CASE WHEN estimated_total_charge >= 90 THEN 5 WHEN estimated_total_charge >= 75 THEN 3 ELSE 0 END
  - CASE WHEN main_risk_factor <> 'Stable customer profile' THEN 4 ELSE 0 END)), 0) AS INTEGER)"""
SCORE = LONG_SCORE.format(p="churn_probability")


def status_sql(score: str, column: int) -> str:
    """One column of the health states: 1 code, 2 label, 3 tone."""
    whens = " ".join(f"WHEN {score} <= {s[0]} THEN '{s[column]}'" for s in L.HEALTH_STATES[:-1])
    return f"CASE {whens} ELSE '{L.HEALTH_STATES[-1][column]}' END"


REVENUE = "CAST(format('{:.2f}', churn_probability * estimated_total_charge) AS DOUBLE)"
DATE = "strftime(scoring_date, '%Y-%m-%d %H:%M:%S')"
PAGE_COLUMNS = f"""customer_id, churn_probability, risk_group, main_risk_factor, estimated_total_charge,
  {DATE} AS scoring_date, segment_name, recommendation_type, recommendation_reason, priority"""


def list_sql(condition: str, limit: int, offset: int) -> str:
    return f"""SELECT {PAGE_COLUMNS}, health_score, {status_sql('health_score', 1)} AS health_code,
  {status_sql('health_score', 2)} AS health_label, {status_sql('health_score', 3)} AS health_tone,
  revenue_at_risk, total_count FROM (
    SELECT *, {SCORE} AS health_score, {REVENUE} AS revenue_at_risk, count(*) OVER () AS total_count
    FROM facts WHERE {condition}) found
  ORDER BY churn_probability DESC NULLS FIRST, customer_id LIMIT {limit} OFFSET {offset}"""


def flat_list(df):
    status = F.col("health_status")
    return df.select(
        *[c for c in df.columns if c != "health_status"],
        status["code"].alias("health_code"),
        status["label"].alias("health_label"),
        status["tone"].alias("health_tone"),
    )


ALL_FILTERS = CustomerFilter(
    search="C0",
    risk_group="Medium",
    segment=L.SERVICE_SEGMENT,
    recommendation=L.SERVICE_CALL,
    min_probability=0.4,
    main_risk_factor=L.CALLS_FACTOR,
)
ALL_FILTERS_SQL = """lower(customer_id) LIKE '%c0%' AND risk_group = 'Medium'
  AND segment_name = 'Service Issue Segment' AND recommendation_type = 'Service Recovery Call'
  AND churn_probability >= 0.4 AND main_risk_factor = 'Customer service calls >= 3'"""
NARROW = ["customer_id", "churn_probability", "segment_name", "recommendation_type"]


def filtered(t: Tables, chosen: CustomerFilter):
    return chosen.apply(customers.result_rows(*t.result_tables)).select(*NARROW)


def filtered_sql(condition: str) -> str:
    return f"SELECT {', '.join(NARROW)} FROM facts WHERE {condition}"


@query("p01_all_filters", filtered_sql(ALL_FILTERS_SQL))
def p01(t: Tables):
    return filtered(t, ALL_FILTERS)


@query("p02_id_search", filtered_sql("lower(customer_id) LIKE '%c_1%'"))
def p02(t: Tables):
    return filtered(t, CustomerFilter(search="C_1", segment="All"))


@query("p02_id_search_backslash", filtered_sql("lower(customer_id) LIKE '%c000%' OR lower(customer_id) LIKE '%c!_%' ESCAPE '!'"))
def p02_backslash(t: Tables):
    """A backslash before a plain character goes; before a wildcard it makes it literal."""
    plain, literal = (filtered(t, CustomerFilter(search=text)) for text in ("C\\000", "C\\_"))
    return plain.union(literal)


@query(
    "p02_indexed_search",
    filtered_sql("lower(customer_id) LIKE '%c00042%' OR lower(customer_id) LIKE '%c%0_7%' OR lower(customer_id) LIKE '%c!_1%' ESCAPE '!'"),
)
def p02_indexed(t: Tables):
    """Searches over the parts that the index of ids leaves; no id is found by two of them."""
    found = []
    for text in ("C00042", "c%0_7", "C\\_1"):
        tables = t.searched(text)
        found.append(CustomerFilter(search=text).apply(customers.result_rows(*tables)).select(*NARROW))
    return found[0].union(found[1]).union(found[2]).distinct()


@query(
    "p03_equalities",
    filtered_sql("segment_name = 'Tariff Optimization Segment' AND recommendation_type = 'Tariff Optimization'"),
)
def p03(t: Tables):
    return filtered(t, CustomerFilter(segment=L.TARIFF_SEGMENT, recommendation=L.TARIFF_OFFER))


@query("p04_min_probability", filtered_sql("churn_probability >= 0.5"))
def p04(t: Tables):
    return filtered(t, CustomerFilter(min_probability=0.5))


@query("p05_customer_list", list_sql("churn_probability >= 0.3", 100, 20))
def p05(t: Tables):
    chosen = CustomerFilter(min_probability=0.3)
    return flat_list(customers.customer_list(*t.result_tables, chosen, 100, 20))


@query("p05_customer_list_all_filters", list_sql(ALL_FILTERS_SQL, 50, 0))
def p05_all(t: Tables):
    return flat_list(customers.customer_list(*t.result_tables, ALL_FILTERS, 50))


@query("w01_total_beside_page", list_sql("TRUE", 50, 100))
def w01(t: Tables):
    return flat_list(customers.customer_list(*t.result_tables, limit=50, offset=100))


def drivers_sql() -> str:
    return """array_to_string(([d FOR d IN [
    CASE WHEN main_risk_factor <> 'Stable customer profile' THEN 'main_risk_factor:' || main_risk_factor || ':high' END,
    CASE WHEN churn_probability >= 0.7
      THEN 'high_churn_probability:' || format('{:.2f}', churn_probability) || ':high' END,
    CASE WHEN estimated_total_charge >= 80
      THEN 'high_estimated_charge:' || format('{:.2f}', estimated_total_charge) || ':medium' END,
    CASE WHEN segment_name <> '' THEN 'segment:' || segment_name || ':medium' END,
    CASE WHEN recommendation_type <> 'No Action' THEN 'recommended_action:' || recommendation_type || ':medium' END
  ] IF d IS NOT NULL])[1:4], '|')"""


POTENTIAL_SQL = """CASE WHEN recommendation_type = 'No Action' THEN 'Low'
  WHEN risk_group IN ('High', 'Medium') THEN risk_group ELSE 'Low' END"""
PROCESSING_SQL = """CAST(CASE coalesce(priority, risk_group) WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END
  AS INTEGER)"""
CARD_SQL = f"""SELECT customer_id, churn_probability, risk_group, segment_id, segment_name,
  recommendation_type, health_score, {status_sql('health_score', 1)} AS health_code,
  {REVENUE} AS revenue_at_risk, {drivers_sql()} AS risk_drivers,
  coalesce(recommendation_type, 'No Action') AS next_action, recommendation_reason AS next_reason,
  priority AS next_priority, {POTENTIAL_SQL} AS reduction_potential,
  {PROCESSING_SQL} AS processing_priority
  FROM (SELECT *, {SCORE} AS health_score FROM facts) cards"""


def driver_text(drivers):
    value = lambda d: F.coalesce(d["value_text"], F.format_string("%.2f", d["value_num"]))
    return F.array_join(
        F.transform(drivers, lambda d: F.concat_ws(":", d["code"], value(d), d["impact"])), "|"
    )


def flat_cards(df):
    h = "health."
    return df.select(
        "customer_id",
        "prediction.churn_probability",
        "prediction.risk_group",
        "segment.segment_id",
        "segment.segment_name",
        "recommendation.recommendation_type",
        F.col(h + "score").alias("health_score"),
        F.col(h + "status.code").alias("health_code"),
        F.col(h + "revenue_at_risk").alias("revenue_at_risk"),
        driver_text(F.col(h + "risk_drivers")).alias("risk_drivers"),
        F.col(h + "next_best_action.recommendation_type").alias("next_action"),
        F.col(h + "next_best_action.recommendation_reason").alias("next_reason"),
        F.col(h + "next_best_action.priority").alias("next_priority"),
        F.col(h + "expected_effect.risk_reduction_potential").alias("reduction_potential"),
        F.col(h + "expected_effect.processing_priority").alias("processing_priority"),
    )


@query("p06_customer_detail", CARD_SQL + " WHERE customer_id = 'C00100'")
def p06(t: Tables):
    return flat_cards(customers.customer_detail(*t.result_tables, "C00100"))


@query("f16_health_card", CARD_SQL)
def f16(t: Tables):
    return flat_cards(customers.customer_cards(*t.result_tables))


@query(
    "p07_segment_customers",
    f"""SELECT {PAGE_COLUMNS}, segment_id FROM facts WHERE segment_name = 'Tariff Optimization Segment'
  ORDER BY churn_probability DESC NULLS FIRST, customer_id LIMIT 100 OFFSET 10""",
)
def p07(t: Tables):
    return customers.segment_customers(*t.result_tables, L.TARIFF_SEGMENT, 100, 10)


@query(
    "p08_recommendation_customers",
    f"""SELECT {PAGE_COLUMNS} FROM facts WHERE recommendation_type = 'Service Recovery Call'
  ORDER BY churn_probability DESC NULLS FIRST, customer_id LIMIT 100 OFFSET 5""",
)
def p08(t: Tables):
    return customers.recommendation_customers(*t.result_tables, L.SERVICE_CALL, 100, 5)


def export_sql(condition: str, fields=None) -> str:
    dictionaries = {
        "risk_group": L.RISK_GROUP_TEXT, "priority": L.PRIORITY_TEXT, "main_risk_factor": L.FACTOR_TEXT,
        "segment_name": L.SEGMENT_TEXT, "recommendation_type": L.ACTION_TEXT,
        "recommendation_reason": L.REASON_TEXT,
    }
    cells = []
    for name in exports.export_fields(fields):
        if name in dictionaries:
            value = sql_case(name, dictionaries[name])
        elif name == "scoring_date":
            value = "strftime(scoring_date, '%d.%m.%Y')"
        elif name == "revenue_at_risk":
            value = decimal_sql("churn_probability * estimated_total_charge")
        elif name == "customer_id":
            value = name
        else:
            value = decimal_sql(name)
        cells.append(f"coalesce({value}, '') AS \"{L.EXPORT_HEADERS[name]}\"")
    return f"SELECT {', '.join(cells)} FROM facts WHERE {condition}"


@query("p09_high_risk_export", export_sql("risk_group = 'High'"))
def p09(t: Tables):
    return exports.high_risk_customers(*t.result_tables)


@query("p10_filtered_export", export_sql("churn_probability >= 0.3 AND risk_group = 'Medium'"))
def p10(t: Tables):
    chosen = CustomerFilter(min_probability=0.3, risk_group="Medium")
    return exports.filtered_customers(*t.result_tables, chosen)


CHOSEN_FIELDS = ["priority", "revenue_at_risk", "segment_name"]


@query("s13_export_fields", export_sql("risk_group = 'High'", CHOSEN_FIELDS))
def s13(t: Tables):
    chosen = CustomerFilter(risk_group="High")
    return exports.filtered_customers(*t.result_tables, chosen, CHOSEN_FIELDS)


@query("s14_guarded_export", export_sql("lower(customer_id) LIKE '%c000%'", ["risk_group"]))
def s14(t: Tables):
    """The guard lets this one through; what it refuses is covered by unit tests."""
    chosen = CustomerFilter(search="c000", min_probability=0.0)
    return exports.filtered_customers(*t.result_tables, chosen, ["risk_group"])


@query(
    "p11_null_safe_difference",
    """SELECT customer_id, r.priority AS stored, x.priority AS expected
  FROM rec_d r JOIN rec x USING (customer_id) WHERE r.priority IS DISTINCT FROM x.priority""",
)
def p11(t: Tables):
    stored = t.drifted_recommendations.select("customer_id", F.col("priority").alias("stored"))
    expected = t.recommendations.select("customer_id", F.col("priority").alias("expected"))
    return stored.join(expected, "customer_id").where(~F.col("stored").eqNullSafe(F.col("expected")))


@query(
    "p12_active_recommendations",
    "SELECT customer_id, recommendation_type FROM facts WHERE recommendation_type <> 'No Action'",
)
def p12(t: Tables):
    rows = filters.active_only(customers.result_rows(*t.result_tables))
    return rows.select("customer_id", "recommendation_type")


@query(
    "p13_defaults",
    """SELECT customer_id, coalesce(churn_probability, 0) AS churn_probability,
  coalesce(recommendation_type, 'No Action') AS recommendation_type FROM facts""",
)
def p13(t: Tables):
    return customers.result_rows(*t.result_tables).select(
        "customer_id",
        F.coalesce("churn_probability", F.lit(0.0)).alias("churn_probability"),
        F.coalesce("recommendation_type", F.lit(L.NO_ACTION)).alias("recommendation_type"),
    )


@query(
    "l01_page_order",
    """SELECT customer_id, churn_probability FROM pred
  ORDER BY churn_probability DESC NULLS FIRST, customer_id LIMIT 500 OFFSET 250""",
)
def l01(t: Tables):
    return customers.top_rows(t.predictions, 500, 250).select("customer_id", "churn_probability")


@query(
    "l01_deep_page",
    """SELECT customer_id, churn_probability FROM pred
  ORDER BY churn_probability DESC NULLS FIRST, customer_id
  LIMIT 100 OFFSET (SELECT CAST(count(*) * 9 // 10 AS BIGINT) FROM pred)""",
)
def l01_deep(t: Tables):
    """A page nine tenths into the table, with a top-k that may hold only a part of it."""
    offset = t.predictions.count() * 9 // 10
    scope, before = customers.page_scope(t.predictions, 100, offset, scope=200)
    page = scope.orderBy(F.desc_nulls_first("churn_probability"), "customer_id").offset(offset - before).limit(100)
    return page.select("customer_id", "churn_probability")


@query(
    "l07_page_bounds",
    """SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / 50) AS BIGINT)) AS pages,
  CAST(CASE WHEN count(*) = 0 THEN 0 ELSE 101 END AS INTEGER) AS first_row, least(150, count(*)) AS last_row
  FROM pred WHERE risk_group = 'Medium'""",
)
def l07(t: Tables):
    return customers.page_bounds(t.predictions.where(F.col("risk_group") == "Medium"), 3, 50)
