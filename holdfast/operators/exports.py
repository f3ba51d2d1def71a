"""Export tables: formatted, translated, with the headers of the files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions import labels as L
from holdfast.functions.text import day_text, decimal_text, percent_text, translated
from holdfast.operators import reports
from holdfast.operators.customers import result_rows
from holdfast.operators.filters import CustomerFilter, check_export
from holdfast.session import saved

_DICTIONARIES = {
    "risk_group": L.RISK_GROUP_TEXT,
    "priority": L.PRIORITY_TEXT,
    "main_risk_factor": L.FACTOR_TEXT,
    "segment_name": L.SEGMENT_TEXT,
    "recommendation_type": L.ACTION_TEXT,
    "recommendation_reason": L.REASON_TEXT,
}
_DECIMALS = ("churn_probability", "estimated_total_charge", "revenue_at_risk")


def export_fields(fields: list[str] | None) -> list[str]:
    """The chosen columns in file order; the id is always among them."""
    if not fields:
        return list(L.EXPORT_HEADERS)
    return [name for name in L.EXPORT_HEADERS if name == "customer_id" or name in fields]


def _cell(name: str) -> Column:
    value = F.col(name)
    if name in _DECIMALS:
        return decimal_text(value)
    if name == "scoring_date":
        return day_text(value)
    if name in _DICTIONARIES:
        value = translated(value, _DICTIONARIES[name])
    return F.coalesce(value.cast("string"), F.lit(""))


def _customer_export(rows: DataFrame, fields: list[str] | None) -> DataFrame:
    revenue = F.col("churn_probability") * F.col("estimated_total_charge")
    ordered = rows.withColumn("revenue_at_risk", revenue).orderBy(
        F.desc_nulls_first("churn_probability"), "customer_id"
    )
    return ordered.select(
        *[_cell(name).alias(L.EXPORT_HEADERS[name]) for name in export_fields(fields)]
    )


def filtered_customers(
    predictions: DataFrame,
    segments: DataFrame,
    recommendations: DataFrame,
    chosen: CustomerFilter,
    fields: list[str] | None = None,
) -> DataFrame:
    """All customers that match, as the customer export shows them."""
    check_export(chosen, fields)
    rows = chosen.apply(result_rows(predictions, segments, recommendations))
    return _customer_export(rows, fields)


def high_risk_customers(
    predictions: DataFrame, segments: DataFrame, recommendations: DataFrame
) -> DataFrame:
    high = predictions.where(F.col("risk_group") == "High")
    return _customer_export(result_rows(high, segments, recommendations), None)


def segments_export(rows: DataFrame) -> DataFrame:
    """The segment summary, grouped by name only. ``rows`` are segment cells."""
    summary = reports.segment_summary(rows, ("segment_name",))
    return summary.select(
        translated(F.col("segment_name"), L.SEGMENT_TEXT).alias("Сегмент"),
        F.col("clients_count").alias("Клиенты"),
        decimal_text(F.col("average_churn_probability")).alias("Средняя вероятность оттока"),
        F.col("high_risk_customers").alias("Клиенты высокого риска"),
        percent_text(F.col("high_risk_share")).alias("Доля высокого риска"),
        decimal_text(F.col("average_estimated_total_charge")).alias("Средние расходы"),
        translated(F.col("main_recommendation"), L.ACTION_TEXT).alias("Основное действие"),
        translated(F.col("main_risk_factor"), L.FACTOR_TEXT).alias("Основной фактор риска"),
    )


def recommendations_export(rows: DataFrame) -> DataFrame:
    """The recommendation plan. ``rows`` are recommendation cells."""

    def text(name: str, entries: dict[str, str]) -> Column:
        return F.coalesce(translated(F.col(name), entries), F.lit(""))

    return reports.recommendation_plan(rows).select(
        text("recommendation_type", L.ACTION_TEXT).alias("Рекомендация"),
        F.col("customers_count").alias("Клиенты"),
        F.col("high_risk_customers").alias("Клиенты высокого риска"),
        decimal_text(F.col("average_churn_probability")).alias("Средняя вероятность оттока"),
        decimal_text(F.col("estimated_revenue_at_risk")).alias("Выручка под риском"),
        text("priority", L.PRIORITY_TEXT).alias("Приоритет"),
        text("recommendation_reason", L.REASON_TEXT).alias("Причина рекомендации"),
        text("main_risk_factor", L.FACTOR_TEXT).alias("Основной фактор риска"),
    )


def dashboard_export(
    predictions: DataFrame, segments: DataFrame, recommendations: DataFrame
) -> DataFrame:
    """Key figures, risk distribution and active recommendations in three columns."""
    shared = saved(reports.dashboard_cells(predictions, segments, recommendations))
    figures = reports.key_figures(shared, blanks=True).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(place).cast("bigint").alias("place"),
                        F.lit(name).alias("metric"),
                        F.coalesce(value, F.lit("")).alias("value"),
                    )
                    for place, (name, value) in enumerate(
                        (
                            ("Всего клиентов", F.col("total_customers").cast("string")),
                            ("Клиенты высокого риска", F.col("high_risk_customers").cast("string")),
                            (
                                "Средняя вероятность оттока",
                                decimal_text(F.col("average_churn_probability"), 4),
                            ),
                            ("Выручка под риском", decimal_text(F.col("estimated_revenue_at_risk"))),
                            ("Дата последнего прогноза", F.col("last_scoring_date")),
                        )
                    )
                ]
            )
        )
    )
    active = shared.where("advised").where(F.col("recommendation_type") != L.NO_ACTION)
    counted = (
        ("Распределение риска", reports.risk_distribution(shared), "risk_group", L.RISK_GROUP_TEXT),
        (
            "Сводка рекомендаций",
            reports.recommendation_counts(active),
            "recommendation_type",
            L.ACTION_TEXT,
        ),
    )
    stacked = figures.select(F.lit(0).alias("part"), F.lit("KPI").alias("section"), "*")
    for part, (section, found, label, entries) in enumerate(counted, start=1):
        stacked = stacked.unionByName(
            found.select(
                F.lit(part).alias("part"),
                F.lit(section).alias("section"),
                (-F.col("customers_count")).alias("place"),
                F.coalesce(translated(F.col(label), entries), F.lit("")).alias("metric"),
                F.col("customers_count").cast("string").alias("value"),
            )
        )
    return stacked.orderBy("part", "place", "metric").select(
        F.col("section").alias("Раздел"),
        F.col("metric").alias("Показатель"),
        F.col("value").alias("Значение"),
    )
