"""Reading and writing: every query writes derived tables and reads them back."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from holdfast import schemas
from holdfast.functions import labels as L
from holdfast.operators import exports, scoring
from holdfast.operators.filters import CustomerFilter
from holdfast.queries.aggregates import UNION_CELLS
from holdfast.queries.customer_pages import export_sql
from holdfast.queries.registry import query
from holdfast.queries.tables import Tables
from holdfast.sources import csv
from holdfast.sources.results import (
    LOG_SCHEMA,
    KeyViolation,
    ResultStore,
    current_jobs,
    prediction_rows,
    recommendation_rows,
    segment_rows,
)

COLUMNS = ", ".join(schemas.CUSTOMERS.names)


def odd_names(t: Tables):
    """The customer table with the kind of headers a hand-made file has."""
    return t.customers.toDF(*[f" {c.replace('_', ' ').title()}" for c in schemas.CUSTOMERS.names])


@query("s01_csv_scan", f"SELECT {COLUMNS} FROM raw")
def s01(t: Tables):
    path = t.scratch("customers_csv")
    t.customers.write.option("header", True).csv(path)
    return csv.read_csv(t.spark, path, schemas.CUSTOMERS)


@query(
    "s01_csv_scan_inferred",
    f"""SELECT {COLUMNS.replace('international_plan', "lower(international_plan) AS international_plan")} FROM raw""",
)
def s01_inferred(t: Tables):
    path = t.scratch("customers_csv")
    t.customers.write.option("header", True).csv(path)
    plan = F.lower(F.col("international_plan").cast("string")).alias("international_plan")
    found = csv.read_csv(t.spark, path)
    return found.select(*[plan if c == "international_plan" else c for c in found.columns])


@query(
    "s01_rejected_rows",
    f"""SELECT id, id % 7 <> 0 AND id % 11 <> 0 AND id % 13 <> 0 AS accepted,
  CASE WHEN id % 7 = 0 THEN 'too many fields' WHEN id % 11 = 0 THEN 'too few fields'
    WHEN id % 13 = 0 THEN 'not of the column''s type' END AS reason,
  CAST(CASE WHEN id % 7 = 0 THEN {len(schemas.CUSTOMERS) + 1} WHEN id % 11 = 0 THEN 3
    WHEN id % 13 = 0 THEN {len(schemas.CUSTOMERS)} END AS INTEGER) AS fields,
  CASE WHEN id % 7 = 0 OR id % 11 = 0 THEN '' WHEN id % 13 = 0 THEN 'account_length,churn' END AS misfits,
  CASE WHEN id % 7 <> 0 AND id % 11 <> 0 AND id % 13 <> 0 THEN total_day_charge END AS total_day_charge FROM raw""",
)
def s01_rejected(t: Tables):
    """Customers as lines, some with a field too many, some cut, some with text in number columns."""
    path, number = t.scratch("ragged_csv"), F.col("id")
    wrong = {c: F.when(number % 13 == 0, F.lit("many")).otherwise(F.col(c).cast("string")) for c in ("account_length", "churn")}
    line = F.to_csv(F.struct(*[wrong.get(c, F.col(c)).alias(c) for c in schemas.CUSTOMERS.names]))
    spoiled = F.when(number % 7 == 0, F.concat(line, F.lit(",beyond"))).when(
        number % 11 == 0, F.to_csv(F.struct("id", "customer_id", "dataset_split"))
    )
    t.customers.select(F.coalesce(spoiled, line)).write.text(path)
    loaded = csv.load_csv(t.spark, path, schemas.CUSTOMERS, header=False)
    rejects = loaded.rejects.select(
        F.split_part("line", F.lit(","), F.lit(1)).cast("bigint").alias("id"), F.lit(False).alias("accepted"),
        "reason", "fields", F.concat_ws(",", "columns").alias("misfits"),
    )
    accepted = loaded.rows.select("id", F.lit(True).alias("accepted"), "total_day_charge")
    return accepted.unionByName(rejects, allowMissingColumns=True)


@query("s02_column_names", f"SELECT {COLUMNS} FROM raw")
def s02(t: Tables):
    return csv.normalize_columns(odd_names(t))


@query("s03_append_landing", "SELECT id, customer_id, state FROM raw UNION ALL SELECT id, customer_id, state FROM raw")
def s03(t: Tables):
    path = t.scratch("customer_features")
    for _ in range(2):
        csv.append_landing(t.customers.select("id", "customer_id", "state"), path)
    return t.spark.read.parquet(path)


@query(
    "s05_full_refresh",
    """SELECT customer_id, CAST(2 AS INTEGER) AS scoring_job_id, risk_group, rule_segment_id AS segment_id,
  rule_type AS recommendation_type FROM ruled""",
)
def s05(t: Tables):
    """Publish once with every customer at no risk, once for real: only the second is seen."""
    store = ResultStore(t.spark, t.scratch("refresh"), t.buckets)
    scored = t.scored
    safe = scoring.enrich_predictions(scored.withColumn("churn_probability", F.lit(0.0)))
    for rows in (safe, scored):
        store.publish(
            store.create_job({}), rows, scoring.customer_segments(rows),
            scoring.customer_recommendations(rows),
        )
    found = store.published()
    return (
        found["predictions"]
        .join(found["customer_segments"], "customer_id")
        .join(found["customer_recommendations"], "customer_id")
        .select("customer_id", "scoring_job_id", "risk_group", "segment_id", "recommendation_type")
    )


@query(
    "s09_two_writers",
    """SELECT customer_id, TRUE AS one_run, TRUE AS own_ids, TRUE AS all_logged FROM pred""",
)
def s09_two_writers(t: Tables):
    """Two runs publish at once, one with every customer at no risk: their ids differ, all entries of both are in
    the log, and the results seen are those of one run in all three tables.
    """
    path, ids = t.scratch("two_writers"), []
    safe = scoring.enrich_predictions(t.scored.withColumn("churn_probability", F.lit(0.0)))

    def run(rows):
        store = ResultStore(t.spark, path, t.buckets)
        ids.append(store.create_job({"model_version": "safe" if rows is safe else "real"}))
        store.publish(ids[-1], rows, scoring.customer_segments(rows), scoring.customer_recommendations(rows))

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(run, (safe, t.scored)))
    store = ResultStore(t.spark, path, t.buckets)
    found, log = store.published(), store.log()
    winner = log.where("status = 'success'").agg(F.max_by("id", "revision").alias("id"), F.max_by("model_version", "revision").alias("kind"))
    seen = found["predictions"].join(found["customer_segments"], "customer_id").join(found["customer_recommendations"], "customer_id")
    right = seen.join(t.scored.select("customer_id", F.col("churn_probability").alias("real")), "customer_id").crossJoin(F.broadcast(winner))
    expected = F.when(F.col("kind") == "safe", 0.0).otherwise(F.col("real"))
    idle = F.col("recommendation_type") == L.NO_ACTION
    return right.select(
        "customer_id",
        (
            (F.col("scoring_job_id") == F.col("id"))
            & (F.col("churn_probability") == expected)
            & (idle == (F.col("churn_probability") < L.MEDIUM_RISK))
        ).alias("one_run"),
        F.lit(sorted(ids) == [1, 2]).alias("own_ids"),
        (log.agg(F.count_distinct("revision")).scalar() == 4).alias("all_logged"),
    )


@query("s05_refused_commit", "SELECT customer_id, churn_probability, TRUE AS refused FROM pred")
def s05_refused(t: Tables):
    """A run with each of three broken keys is refused; the results before it stay."""
    store, scored = ResultStore(t.spark, t.scratch("refused"), t.buckets), t.scored
    good = (scored, scoring.customer_segments(scored), scoring.customer_recommendations(scored))
    store.publish(store.create_job({}), *good)
    nobody = F.lit("nobody").alias("customer_id")
    broken = (
        (good[0].unionByName(scored.limit(1)), *good[1:]),
        (good[0], good[1].unionByName(good[1].limit(1).withColumn("customer_id", F.lit(None).cast("string"))), good[2]),
        (*good[:2], good[2].unionByName(good[2].limit(1).select(nobody, *good[2].columns[1:]))),
    )
    refused = 0
    for tables in broken:
        job = store.create_job({})
        try:
            store.publish(job, *tables)
        except KeyViolation:
            store.update_status(job, "failed")
            refused += 1
    rows = store.published()["predictions"].select("customer_id", "churn_probability")
    failed = store.jobs().where("status = 'failed'").agg(F.count("*")).scalar()
    return rows.withColumn("refused", (failed == 3) & F.lit(refused == 3))


@query(
    "s06_prediction_rows",
    """SELECT customer_id, CAST(7 AS INTEGER) AS scoring_job_id, churn_probability, risk_group,
  main_risk_factor, estimated_total_charge FROM pred""",
)
def s06(t: Tables):
    path = t.scratch("predictions")
    prediction_rows(t.scored, 7).write.parquet(path)
    return t.spark.read.parquet(path).drop("scoring_date")


@query("s07_segment_rows", "SELECT customer_id, segment_id, segment_name FROM seg")
def s07(t: Tables):
    path = t.scratch("segments")
    segment_rows(t.segments).write.parquet(path)
    return t.spark.read.parquet(path)


@query("s08_recommendation_rows", "SELECT * FROM rec")
def s08(t: Tables):
    path = t.scratch("recommendations")
    recommendation_rows(t.recommendations).write.parquet(path)
    return t.spark.read.parquet(path)


def job_log(t: Tables):
    """A log in which every job was started and all but the running ones have ended."""
    ended = t.jobs.withColumns({"revision": F.lit(2).cast("bigint"), "buckets": F.lit(8), "folder": F.lit(""), "layout": F.lit("{}")})
    started = ended.withColumns({"revision": F.lit(1).cast("bigint"), "status": F.lit("running")})
    return started.unionByName(ended.where(F.col("status") != "running")).select(*LOG_SCHEMA.names)


@query("s10_current_job_status", "SELECT id, status, roc_auc FROM jobs")
def s10(t: Tables):
    path = t.scratch("scoring_jobs")
    job_log(t).write.parquet(path)
    return current_jobs(t.spark.read.schema(LOG_SCHEMA).parquet(path)).select("id", "status", "roc_auc")


def read_back(t: Tables, path: str, names: list[str]):
    """A written export, without the byte order mark of its first header."""
    reader = t.spark.read.option("header", True).option("sep", ";").option("escape", '"')
    return reader.option("lineSep", "\r\n").csv(path).toDF(*names).na.fill("")


@query("s11_customer_csv", export_sql("risk_group = 'High'"))
def s11(t: Tables):
    path = t.scratch("export")
    rows = exports.filtered_customers(*t.result_tables, CustomerFilter(risk_group="High"))
    csv.write_report_csv(rows, path, keep_empty=True)
    return read_back(t, path, list(L.EXPORT_HEADERS.values()))


@query("s12_summary_csv", UNION_CELLS)
def s12(t: Tables):
    path = t.scratch("summary")
    rows = exports.dashboard_export(*t.result_tables)
    csv.write_report_csv(rows, path, keep_empty=False, single_file=True)
    return read_back(t, path, rows.columns)
