"""Customer lists, drill-downs and the customer card.

Result tables hold one row per customer (``quality.key_problems`` checks it), so
a page can be cut from the predictions alone and the other two tables are then
looked up for its rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions import health
from holdfast.functions.numbers import zero_if_null
from holdfast.functions.rules import risk_rank
from holdfast.functions.text import timestamp_text
from holdfast.operators.filters import PAGE_LIMIT, CustomerFilter, check_page
from holdfast.session import saved

# Rows a top-k may hold for one page; see ``top_rows``.
PAGE_SCOPE = 20_000
# Steps of probability that are counted first, and keys that cut the order into ranges, per pass.
STEPS, SPLITTERS = 4096, 64


def result_rows(predictions: DataFrame, segments: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Every prediction with its segment and recommendation, where it has them."""
    return predictions.join(segments, "customer_id", "left").join(
        recommendations, "customer_id", "left"
    )


def _order() -> tuple[Column, Column]:
    return F.desc_nulls_first("churn_probability"), F.asc("customer_id")


def _order_key() -> Column:
    """Rises in the order of pages: NULL probability first, then falling probability, then id."""
    p = F.col("churn_probability")
    return F.struct(p.isNotNull().alias("known"), (-p).alias("falling"), F.col("customer_id").alias("id"))


def _literal(key) -> Column:
    return F.struct(
        F.lit(key["known"]).alias("known"),
        F.lit(key["falling"]).cast("double").alias("falling"),
        F.lit(key["id"]).alias("id"),
    )


def page_scope(df: DataFrame, count: int, skip: int, scope: int = PAGE_SCOPE) -> tuple[DataFrame, int]:
    """A range of the order that holds a page, and how many rows come before the range.

    A page within the first ``scope`` rows needs no range. For others, rows are counted per step of
    probability in one pass, and those of the steps that hold the page are kept. Where these are
    more than ``scope`` still, they are counted per range between sampled keys, and the ranges that
    hold the page are cut again, until a top-k over them holds ``scope`` rows at most. Only counts
    and the sampled keys leave the executors; rows are neither sorted nor written.
    """
    if skip + count <= scope:
        return df, 0
    df, before, size = _probability_range(df, count, skip)
    keys = df.select(_order_key().alias("key"))
    low = high = None
    while skip - before + count > scope and size > scope and skip < before + size:
        sample = keys.sample(min(1.0, 4 * SPLITTERS / size), seed=len(str(size))).limit(16 * SPLITTERS)
        found = sorted((r["key"] for r in sample.collect()), key=_python_order)
        cuts = found[:: max(1, len(found) // SPLITTERS)]
        if not cuts:
            break
        place = F.size(F.filter(F.array(*map(_literal, cuts)), lambda cut: cut <= F.col("key")))
        counts = dict(keys.groupBy(place.alias("range")).count().collect())
        first = last = start = None
        at = before
        for k in range(len(cuts) + 1):
            end = at + counts.get(k, 0)
            if first is None and end > skip:
                first, start = k, at
            if first is not None and last is None and end >= min(skip + count, before + size):
                last, stop = k, end
            at = end
        if stop - start == size:
            break
        low = cuts[first - 1] if first else low
        high = cuts[last] if last < len(cuts) else high
        before, size = start, stop - start
        keys = df.select(_order_key().alias("key"))
        if low is not None:
            keys = keys.where(F.col("key") >= _literal(low))
        if high is not None:
            keys = keys.where(F.col("key") < _literal(high))
    if low is not None:
        df = df.where(_order_key() >= _literal(low))
    if high is not None:
        df = df.where(_order_key() < _literal(high))
    return df, before


def _step() -> Column:
    """Number of the step of probability, in the order of pages; unknown ones come first."""
    p = F.col("churn_probability")
    number = F.greatest(F.lit(0), F.least(F.lit(STEPS - 1), F.floor((1 - p) * STEPS)))
    return F.when(p.isNull(), -1).otherwise(number).cast("int")


def _probability_range(df: DataFrame, count: int, skip: int) -> tuple[DataFrame, int, int]:
    """The rows of the steps that hold a page, and the numbers of rows before them and in them."""
    counts = sorted((r["step"], r["n"]) for r in df.groupBy(_step().alias("step")).agg(F.count("*").alias("n")).collect())
    before, at, kept = 0, 0, []
    for step, n in counts:
        if at + n <= skip:
            before = at + n
        elif at < skip + count:
            kept.append((step, n))
        at += n
    if not kept:
        return df.where(F.lit(False)), before, 0
    first, last = kept[0][0], kept[-1][0]
    df = df.where(_step().between(first, last))
    # The same range once more, a little wider, in a form that reaches the files.
    p = F.col("churn_probability")
    if first > 0:
        df = df.where(p <= 1 - first / STEPS + 1e-9)
    if 0 <= first and last < STEPS - 1:
        df = df.where(p >= 1 - (last + 1) / STEPS - 1e-9)
    return df, before, sum(n for _, n in kept)


def _python_order(key) -> tuple:
    return key["known"], key["falling"] is not None, key["falling"] or 0.0, key["id"] is not None, (key["id"] or "").encode()


def top_rows(df: DataFrame, count: int, skip: int = 0) -> DataFrame:
    """Rows in order of falling probability, NULL first, ids deciding ties; ``count`` rows after ``skip``.

    The page is written once, so what follows reads its few rows and not the tables behind it.
    """
    check_page(count, skip)
    scope, before = page_scope(df, count, skip)
    ordered = scope.orderBy(*_order())
    page = ordered.offset(skip - before) if skip > before else ordered
    return saved(page.limit(count)).orderBy(*_order())


def look_up(page: DataFrame, *tables: DataFrame) -> DataFrame:
    """Left join of a page with large tables.

    The tables are first reduced to the page's keys by a broadcast semi join, so
    they are scanned but not shuffled. More rows than a page may have are refused.
    """
    if page.limit(PAGE_LIMIT + 1).count() > PAGE_LIMIT:
        raise ValueError(f"a page has {PAGE_LIMIT} rows at most")
    keys = page.select("customer_id")
    for table in tables:
        found = table.join(F.broadcast(keys), "customer_id", "left_semi")
        page = page.join(found, "customer_id", "left")
    return page


def _known_numbers(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {c: zero_if_null(F.col(c)) for c in ("churn_probability", "estimated_total_charge")}
    )


def _score() -> Column:
    return health.health_score(
        F.col("churn_probability"), F.col("risk_group"), F.col("main_risk_factor"),
        F.col("estimated_total_charge"),
    )


def customer_list(
    predictions: DataFrame,
    segments: DataFrame,
    recommendations: DataFrame,
    chosen: CustomerFilter = CustomerFilter(),
    limit: int = 100,
    offset: int = 0,
) -> DataFrame:
    """One page of customers with health fields and the number of matches.

    A page beyond the end has no rows and therefore no number either.
    """
    check_page(limit, offset)
    matches = predictions
    late = []
    for table, needed in (
        (segments, chosen.needs_segments()),
        (recommendations, chosen.needs_recommendations()),
    ):
        if needed:
            matches = matches.join(table, "customer_id")
        else:
            late.append(table)
    matches = chosen.apply(matches)
    total = matches.agg(F.count("*")).scalar()
    page = look_up(top_rows(matches, limit, offset), *late)
    score = _score()
    ordered = page.orderBy(*_order())
    return (
        _known_numbers(ordered)
        .select(
            "customer_id",
            "churn_probability",
            "risk_group",
            "main_risk_factor",
            "estimated_total_charge",
            timestamp_text(F.col("scoring_date")).alias("scoring_date"),
            "segment_name",
            "recommendation_type",
            "recommendation_reason",
            "priority",
            score.alias("health_score"),
            health.health_status(score).alias("health_status"),
            health.revenue_at_risk(
                F.col("churn_probability"), F.col("estimated_total_charge")
            ).alias("revenue_at_risk"),
            total.alias("total_count"),
        )
    )


def page_payload(page: DataFrame, limit: int, offset: int) -> dict:
    """A page of ``customer_list`` as plain values; beyond the end the total is 0."""
    rows = [row.asDict(recursive=True) for row in page.collect()]
    total = rows[0]["total_count"] if rows else 0
    items = [{name: value for name, value in row.items() if name != "total_count"} for row in rows]
    return {"items": items, "total": total, "limit": limit, "offset": offset}


def customer_cards(
    predictions: DataFrame, segments: DataFrame, recommendations: DataFrame
) -> DataFrame:
    """The nested card of every customer."""
    rows = _known_numbers(result_rows(predictions, segments, recommendations))
    card = health.health_card(
        *[
            F.col(name)
            for name in (
                "churn_probability", "risk_group", "main_risk_factor", "estimated_total_charge",
                "segment_name", "recommendation_type", "recommendation_reason", "priority",
            )
        ]
    )
    return rows.select(
        "customer_id",
        F.struct(
            "churn_probability",
            "risk_group",
            "main_risk_factor",
            "estimated_total_charge",
            timestamp_text(F.col("scoring_date")).alias("scoring_date"),
        ).alias("prediction"),
        F.struct("segment_id", "segment_name").alias("segment"),
        F.struct("recommendation_type", "recommendation_reason", "priority").alias("recommendation"),
        card.alias("health"),
    )


def customer_detail(
    predictions: DataFrame, segments: DataFrame, recommendations: DataFrame, customer_id: str
) -> DataFrame:
    """The card of one customer; no row if there is none."""
    wanted = predictions.where(F.col("customer_id") == customer_id)
    return customer_cards(wanted, segments, recommendations).limit(1)


def _drill_down(first: DataFrame, other: DataFrame, columns: list[str], limit: int, offset: int) -> DataFrame:
    check_page(limit, offset)
    page = look_up(top_rows(first, limit, offset), other)
    return (
        page.withColumns(
            {
                "estimated_total_charge": zero_if_null(F.col("estimated_total_charge")),
                "scoring_date": timestamp_text(F.col("scoring_date")),
            }
        )
        .select(*columns)
        .orderBy(*_order())
    )


_LIST = [
    "customer_id", "churn_probability", "risk_group", "main_risk_factor", "estimated_total_charge",
    "scoring_date", "segment_name", "recommendation_type", "recommendation_reason", "priority",
]


def segment_customers(
    predictions: DataFrame, segments: DataFrame, recommendations: DataFrame,
    segment_name: str, limit: int = 100, offset: int = 0,
) -> DataFrame:
    """One page of a segment's customers."""
    members = segments.where(F.col("segment_name") == segment_name).join(predictions, "customer_id")
    return _drill_down(members, recommendations, [*_LIST, "segment_id"], limit, offset)


def recommendation_customers(
    predictions: DataFrame, segments: DataFrame, recommendations: DataFrame,
    recommendation_type: str, limit: int = 100, offset: int = 0,
) -> DataFrame:
    """One page of the customers with a recommendation."""
    advised = recommendations.where(F.col("recommendation_type") == recommendation_type)
    return _drill_down(advised.join(predictions, "customer_id"), segments, _LIST, limit, offset)


def page_bounds(matches: DataFrame, page: int, page_size: int) -> DataFrame:
    """Number of pages and the first and last row of one page (1-based)."""
    total = F.count("*")
    return matches.agg(total.alias("total")).select(
        "total",
        F.greatest(F.lit(1), F.ceil(F.col("total") / page_size)).alias("pages"),
        F.when(F.col("total") == 0, 0).otherwise((page - 1) * page_size + 1).alias("first_row"),
        F.least(F.lit(page * page_size), F.col("total")).alias("last_row"),
    )


def filter_options(
    predictions: DataFrame, segments: DataFrame, recommendations: DataFrame
) -> dict[str, DataFrame]:
    """The distinct values each filter offers."""
    def values(df: DataFrame, column: str) -> DataFrame:
        return df.where(F.col(column).isNotNull()).select(column).distinct()

    # One scan of the predictions for both of their lists.
    predicted = saved(predictions.groupBy("risk_group", "main_risk_factor").agg(F.count("*").alias("n")))
    groups = values(predicted, "risk_group")
    return {
        "risk_groups": groups.orderBy(risk_rank(F.col("risk_group")), "risk_group"),
        "segments": values(segments, "segment_name").orderBy("segment_name"),
        "recommendations": values(recommendations, "recommendation_type").orderBy("recommendation_type"),
        "main_risk_factors": values(predicted, "main_risk_factor").orderBy("main_risk_factor"),
    }
