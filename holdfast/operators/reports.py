"""Reports over the result tables.

Every report works on *cells*: rows grouped by a few labels, with counts and sums
(``cells``). Customers are combined into cells before anything is shuffled, so a
label that holds a third of all customers still arrives as one row per task, and
everything after that (shares, ranks, most frequent values) runs on a handful of
rows. A report needs only the labels it names; given finer cells, such as those
the dashboard shares between its sections, it returns the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions import labels as L
from holdfast.functions import rules, screen
from holdfast.functions.text import timestamp_text
from holdfast.session import saved

MEASURES = {
    "customers": F.sum,
    "scored": F.sum,
    "probability_sum": F.sum,
    "charged": F.sum,
    "charge_sum": F.sum,
    "revenue_sum": F.sum,
    "last_scoring_date": F.max,
}


def cells(rows: DataFrame, *labels: str) -> DataFrame:
    """Combine customers with equal labels."""
    revenue = F.col("churn_probability") * F.col("estimated_total_charge")
    return rows.groupBy(*labels).agg(
        F.count("*").alias("customers"),
        F.count("churn_probability").alias("scored"),
        F.sum("churn_probability").alias("probability_sum"),
        F.count("estimated_total_charge").alias("charged"),
        F.sum("estimated_total_charge").alias("charge_sum"),
        F.sum(revenue).alias("revenue_sum"),
        F.max("scoring_date").alias("last_scoring_date"),
    )


def _customers() -> Column:
    return F.sum("customers")


def _high_risk() -> Column:
    return F.sum(F.when(F.col("risk_group") == "High", F.col("customers")).otherwise(0))


def _mean_probability() -> Column:
    return F.try_divide(F.sum("probability_sum"), F.sum("scored"))


def _mean_charge() -> Column:
    return F.try_divide(F.sum("charge_sum"), F.sum("charged"))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def _counted(rows: DataFrame, *labels: str) -> DataFrame:
    """Customers per combination of labels."""
    return rows.groupBy(*labels).agg(_customers().alias("n"))


def with_label_counts(rows: DataFrame, group: list[str], labels: list[str]) -> DataFrame:
    """Beside each cell, how many customers of its group have its label.

    One exchange by the group serves all labels and the aggregate that follows,
    so the result tables are read once however many labels a report needs.
    """
    found = rows.repartition(*group)
    for label in labels:
        same = Window.partitionBy(*group, label)
        found = found.withColumn(f"{label}__n", F.sum("customers").over(same))
    return found


def most_frequent(label: str, wanted: Column | None = None, tie: Column | None = None) -> Column:
    """Aggregate over ``with_label_counts``: the label most customers have.

    Ties go to ``tie``, then to the lowest label; NULL labels and those not
    ``wanted`` are left out.
    """
    wanted = F.col(label).isNotNull() if wanted is None else wanted
    order = [(-F.col(f"{label}__n")).alias("n"), *([tie.alias("tie")] if tie is not None else []), F.col(label)]
    return F.min_by(label, F.when(wanted, F.struct(*order))).alias(label)


# Key figures and distributions


def key_figures(rows: DataFrame, blanks: bool = False) -> DataFrame:
    """One row of totals. On empty input the dashboard shows 0, an export leaves blanks."""
    figures = rows.agg(
        F.coalesce(_customers(), F.lit(0)).alias("total_customers"),
        _high_risk().alias("high_risk_customers"),
        _mean_probability().alias("average_churn_probability"),
        F.sum("revenue_sum").alias("estimated_revenue_at_risk"),
        timestamp_text(F.max("last_scoring_date")).alias("last_scoring_date"),
    )
    if blanks:
        return figures
    return figures.withColumns(
        {
            "high_risk_customers": F.coalesce("high_risk_customers", F.lit(0)),
            "average_churn_probability": F.coalesce("average_churn_probability", F.lit(0.0)),
            "estimated_revenue_at_risk": F.coalesce("estimated_revenue_at_risk", F.lit(0.0)),
        }
    )


def with_total(counts: DataFrame, column: str, name: str = "total") -> DataFrame:
    """The sum of a column beside each row, for reports of one row per label."""
    return counts.withColumn(name, F.sum(column).over(Window.partitionBy()))


def risk_distribution(rows: DataFrame) -> DataFrame:
    found = rows.groupBy("risk_group").agg(_customers().alias("customers_count"))
    return found.orderBy(F.desc("customers_count"), "risk_group")


def mean_probability_by_segment(rows: DataFrame) -> DataFrame:
    found = rows.groupBy(F.col("segment_name").alias("segment")).agg(
        _mean_probability().alias("average_churn_probability")
    )
    return _null_mean_as_zero(
        found.orderBy(F.desc_nulls_first("average_churn_probability"), "segment")
    )


def _null_mean_as_zero(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "average_churn_probability", F.coalesce("average_churn_probability", F.lit(0.0))
    )


def high_risk_share_by_segment(rows: DataFrame) -> DataFrame:
    found = rows.groupBy(F.col("segment_name").alias("segment")).agg(
        _customers().alias("n"), _high_risk().alias("high")
    )
    return found.orderBy(F.desc("high"), "segment").select(
        "segment", _share(F.col("high"), F.col("n")).alias("high_risk_share")
    )


def recommendation_counts(rows: DataFrame) -> DataFrame:
    found = rows.groupBy("recommendation_type").agg(_customers().alias("customers_count"))
    return found.orderBy(F.desc("customers_count"), "recommendation_type")


def active_total(counts: DataFrame) -> DataFrame:
    """Customers with a recommendation other than no action, a missing one included."""
    other = ~F.col("recommendation_type").eqNullSafe(F.lit(L.NO_ACTION))
    return counts.where(other).agg(
        F.coalesce(F.sum("customers_count"), F.lit(0)).alias("active_recommendations")
    )


def top_actions(counts: DataFrame, count: int = 4) -> DataFrame:
    """The most common actions, as the dashboard lists them."""
    other = ~F.col("recommendation_type").eqNullSafe(F.lit(L.NO_ACTION))
    return counts.where(other).orderBy(F.desc("customers_count"), "recommendation_type").limit(count)


def top_risk_factors(rows: DataFrame, count: int = 5) -> DataFrame:
    """The most common factors among high-risk customers and their share of them."""
    high = rows.where((F.col("risk_group") == "High") & F.col("main_risk_factor").isNotNull())
    found = high.groupBy(F.col("main_risk_factor").alias("factor")).agg(
        _customers().alias("customers_count")
    )
    share = _share(F.col("customers_count"), F.col("total"))
    top = with_total(found, "customers_count").orderBy(F.desc("customers_count"), "factor").limit(count)
    return top.select(
        "factor", "customers_count", share.alias("high_risk_share"), rules.impact(share).alias("impact")
    )


def priority_segments(rows: DataFrame, count: int = 3) -> DataFrame:
    """The segments with the highest mean probability."""
    labels = ["main_risk_factor", "recommendation_type"]
    stats = (
        with_label_counts(rows, ["segment_name"], labels)
        .groupBy("segment_name")
        .agg(
            _customers().alias("clients_count"),
            _mean_probability().alias("average_churn_probability"),
            _high_risk().alias("high"),
            *[most_frequent(label) for label in labels],
        )
    )
    top = stats.orderBy(F.desc_nulls_first("average_churn_probability"), "segment_name").limit(count)
    return _null_mean_as_zero(top).select(
        F.col("segment_name").alias("segment"),
        "clients_count",
        "average_churn_probability",
        _share(F.col("high"), F.col("clients_count")).alias("high_risk_share"),
        "main_risk_factor",
        F.col("recommendation_type").alias("main_recommendation"),
    )


# Segments


def recommendation_ranks(rows: DataFrame, key: list[str]) -> DataFrame:
    """Active recommendations of each segment, the most common first."""
    active = rows.where(F.col("recommendation_type") != L.NO_ACTION)
    order = Window.partitionBy(*key).orderBy(F.desc("recommendation_count"), "recommendation_type")
    return (
        _counted(active, *key, "recommendation_type")
        .withColumnRenamed("n", "recommendation_count")
        .withColumn("row_number", F.row_number().over(order))
    )


def factor_ranks(rows: DataFrame, key: list[str]) -> DataFrame:
    """Risk factors of each segment, the most common first, ties in factor order."""
    named = rows.where(F.col("main_risk_factor") != L.STABLE_FACTOR)
    order = Window.partitionBy(*key).orderBy(
        F.desc("factor_count"), rules.factor_rank(F.col("main_risk_factor")), "main_risk_factor"
    )
    return (
        _counted(named, *key, "main_risk_factor")
        .withColumnRenamed("n", "factor_count")
        .withColumn("row_number", F.row_number().over(order))
    )


def segment_stats(rows: DataFrame, key: list[str], *more: Column) -> DataFrame:
    return rows.groupBy(*key).agg(
        _customers().alias("clients_count"),
        _mean_probability().alias("average_churn_probability"),
        _high_risk().alias("high_risk_customers"),
        _mean_charge().alias("average_estimated_total_charge"),
        *more,
    )


def with_leaders(stats: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Segment figures with each segment's first-ranked recommendation and factor.

    A segment without a name or number matches no ranking, as in an SQL join.
    """
    first = F.col("row_number") == 1
    actions = recommendation_ranks(rows, key).where(first).select(*key, "recommendation_type")
    factors = factor_ranks(rows, key).where(first).select(*key, "main_risk_factor")
    return stats.join(actions, key, "left").join(factors, key, "left")


def segment_summary(rows: DataFrame, key: tuple[str, ...] = ("segment_id", "segment_name")) -> DataFrame:
    """Figures, main recommendation and main factor of each segment.

    The segment page groups by id and name, the export by name only. The result
    is that of ``with_leaders``, found in one pass over the cells.
    """
    key = list(key)
    named = F.lit(True)
    for part in key:
        named = named & F.col(part).isNotNull()
    merged = segment_stats(
        with_label_counts(rows, key, ["recommendation_type", "main_risk_factor"]),
        key,
        most_frequent("recommendation_type", named & (F.col("recommendation_type") != L.NO_ACTION)),
        most_frequent(
            "main_risk_factor",
            named & (F.col("main_risk_factor") != L.STABLE_FACTOR),
            rules.factor_rank(F.col("main_risk_factor")),
        ),
    )
    factor = rules.segment_factor(
        F.col("segment_name"), F.col("recommendation_type"), F.col("main_risk_factor")
    )
    ordered = merged.orderBy(F.desc_nulls_first("average_churn_probability"), *key)
    return _null_mean_as_zero(ordered).select(
        *key,
        "clients_count",
        "high_risk_customers",
        "average_churn_probability",
        _share(F.col("high_risk_customers"), F.col("clients_count")).alias("high_risk_share"),
        F.coalesce("average_estimated_total_charge", F.lit(0.0)).alias("average_estimated_total_charge"),
        F.coalesce("recommendation_type", F.lit(L.NO_ACTION)).alias("main_recommendation"),
        factor.alias("main_risk_factor"),
    )


def portfolio_mean(summary: DataFrame) -> DataFrame:
    """Mean probability over all segments, weighted by their size."""
    weighted = F.sum(F.col("average_churn_probability") * F.col("clients_count"))
    return summary.agg(
        F.coalesce(weighted / F.sum("clients_count"), F.lit(0.0)).alias("portfolio_average_risk")
    )


def segment_profiles(summary: DataFrame) -> DataFrame:
    """Attention level, tones and the distance to the portfolio mean of each segment."""
    mean = F.col("average_churn_probability")
    share = F.col("high_risk_share")
    overall = F.col("portfolio_average_risk")
    level = screen.attention_level(mean, share, F.col("high_risk_customers"))
    everything = Window.partitionBy()  # one row per segment
    weighted = F.sum(mean * F.col("clients_count")).over(everything)
    return summary.withColumn(
        "portfolio_average_risk", weighted / F.sum("clients_count").over(everything)
    ).select(
        "segment_name",
        "portfolio_average_risk",
        level["label"].alias("attention_label"),
        level["tone"].alias("attention_tone"),
        screen.points_from(mean, overall).alias("difference_points"),
        screen.direction_from(mean, overall).alias("difference_direction"),
        screen.share_tone(share).alias("share_tone"),
        screen.probability_tone(mean).alias("probability_tone"),
    )


# Recommendations


def recommendation_plan(rows: DataFrame) -> DataFrame:
    """Counts, revenue at risk and most frequent labels of each active recommendation."""
    key = ["recommendation_type"]
    labels = ["recommendation_reason", "priority", "main_risk_factor"]
    active = rows.where(F.col("recommendation_type") != L.NO_ACTION)
    high_priority = F.when(F.col("priority") == "High", F.col("customers")).otherwise(0)
    plan = (
        with_label_counts(active, key, labels)
        .groupBy(*key)
        .agg(
            _customers().alias("customers_count"),
            _high_risk().alias("high_risk_customers"),
            F.sum(high_priority).alias("high_priority_customers"),
            _mean_probability().alias("average_churn_probability"),
            F.sum("revenue_sum").alias("estimated_revenue_at_risk"),
            *[most_frequent(label) for label in labels],
        )
    )
    ordered = plan.orderBy(F.desc_nulls_first("estimated_revenue_at_risk"), *key)
    return _null_mean_as_zero(ordered).select(
        *key,
        "customers_count",
        "high_risk_customers",
        "high_priority_customers",
        "average_churn_probability",
        _share(F.col("high_risk_customers"), F.col("customers_count")).alias("high_risk_share"),
        F.coalesce("estimated_revenue_at_risk", F.lit(0.0)).alias("estimated_revenue_at_risk"),
        *labels,
    )


# Scoring jobs


def latest_success(jobs: DataFrame, with_metrics: bool = False) -> DataFrame:
    """The latest successful job, optionally the latest that has all its metrics."""
    done = jobs.where(F.col("status") == "success")
    if with_metrics:
        done = done.dropna(subset=["roc_auc", "f1_score", "recall"])
    return done.orderBy(F.desc_nulls_first("scoring_date"), F.desc("id")).limit(1)


def scoring_info(jobs: DataFrame) -> DataFrame:
    """The latest job with the metrics of the latest training; one row even without jobs.

    Both are the maximum of one order (date, NULL first, then id), so one
    aggregate finds them without a sort or a join.
    """
    date = F.col("scoring_date")
    order = F.struct(date.isNull().alias("undated"), date.alias("date"), F.col("id"))
    measured = F.col("roc_auc").isNotNull() & F.col("f1_score").isNotNull() & F.col("recall").isNotNull()
    found = jobs.where(F.col("status") == "success").agg(
        F.max_by(F.struct(*jobs.columns), order).alias("job"),
        F.max_by(F.struct(*jobs.columns), F.when(measured, order)).alias("trained"),
    )

    def threshold(name: str, default: float):
        stored = F.col(f"job.{name}")
        return F.coalesce(F.when(stored != 0, stored), F.lit(default)).alias(name)

    return found.select(
        "job.model_name",
        "job.model_version",
        "job.algorithm",
        "trained.roc_auc",
        "trained.f1_score",
        "trained.recall",
        threshold("high_risk_threshold", L.HIGH_RISK),
        threshold("medium_risk_threshold", L.MEDIUM_RISK),
        timestamp_text(F.col("job.scoring_date")).alias("last_scoring_date"),
        timestamp_text(F.col("trained.scoring_date")).alias("last_training_date"),
    )


# Dashboard


def dashboard_cells(
    predictions: DataFrame, segments: DataFrame, recommendations: DataFrame
) -> DataFrame:
    """The cells all dashboard sections share: one pass over the three tables."""
    marked_s = segments.withColumn("in_segment", F.lit(True))
    marked_r = recommendations.withColumn("advised", F.lit(True))
    rows = predictions.join(marked_s, "customer_id", "left").join(marked_r, "customer_id", "left")
    return cells(
        rows, "risk_group", "main_risk_factor", "in_segment", "segment_name", "advised",
        "recommendation_type",
    )


def dashboard_sections(shared: DataFrame, jobs: DataFrame) -> dict[str, DataFrame]:
    """The eight dashboard sections over ``dashboard_cells``, which should be saved before."""
    members = shared.where("in_segment")
    return {
        "kpis": key_figures(shared),
        "risk_distribution": risk_distribution(shared),
        "average_churn_by_segment": mean_probability_by_segment(members),
        "high_risk_share_by_segment": high_risk_share_by_segment(members),
        "recommendations_summary": recommendation_counts(shared.where("advised")),
        "top_risk_factors": top_risk_factors(shared),
        "priority_segments": priority_segments(members),
        "scoring_info": scoring_info(jobs),
    }


def dashboard_summary(
    predictions: DataFrame, segments: DataFrame, recommendations: DataFrame, jobs: DataFrame
) -> dict[str, DataFrame]:
    """The eight dashboard sections. Their cells are computed and written once."""
    return dashboard_sections(saved(dashboard_cells(predictions, segments, recommendations)), jobs)
