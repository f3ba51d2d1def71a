"""Model, metrics, runs and synthetic customers.

A fitted model has no SQL counterpart: queries around it report what must hold
whatever the model is, per customer or split.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from operator import and_

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from holdfast.functions import draws
from holdfast.operators import augment
from holdfast.operators.features import prepare_features
from holdfast.operators.metrics import METRICS, binary_metrics
from holdfast.plans import model, runs
from holdfast.queries.registry import query, rounded
from holdfast.queries.tables import Tables
from holdfast.sources.results import ResultStore

METRICS_SQL = """(SELECT
  (sum(mid_rank) FILTER (churn = 1) - p * (p + 1) / 2) / (p * (count(*) - p)) AS roc_auc,
  2 * tp / (p + called) AS f1_score, tp / p AS recall, tp / called AS precision,
  (tp + count(*) - p - called + tp) / count(*) AS accuracy
  FROM (SELECT churn, avg(place) OVER (PARTITION BY churn_probability) AS mid_rank,
          sum(churn) OVER () AS p, count(*) FILTER (churn_probability >= 0.5) OVER () AS called,
          count(*) FILTER (churn_probability >= 0.5 AND churn = 1) OVER () AS tp
        FROM (SELECT churn, churn_probability, row_number() OVER (ORDER BY churn_probability) AS place
              FROM raw WHERE dataset_split = 'test') placed) ranked_rows
  GROUP BY p, called, tp) metrics"""
SHOWN_METRICS = ", ".join(f"round({m}, 6) AS {m}" for m in METRICS)


def test_rows(t: Tables):
    return t.inputs.where(F.col("dataset_split") == "test")


@query("a18_binary_metrics", f"SELECT {SHOWN_METRICS} FROM {METRICS_SQL}")
def a18(t: Tables):
    return rounded(binary_metrics(test_rows(t)), *METRICS)


@query(
    "a18_metrics_by_split",
    """SELECT dataset_split,
  round((sum(mid_rank) FILTER (churn = 1) - p * (p + 1) / 2) / nullif(p * (count(*) - p), 0), 6) AS roc_auc,
  coalesce(round(2 * tp / nullif(p + called, 0), 6), 0) AS f1_score, coalesce(round(tp / nullif(p, 0), 6), 0) AS recall,
  coalesce(round(tp / nullif(called, 0), 6), 0) AS precision,
  round((tp + count(*) - p - called + tp) / count(*), 6) AS accuracy
  FROM (SELECT dataset_split, churn, avg(place) OVER (PARTITION BY dataset_split, churn_probability) AS mid_rank,
          sum(churn) OVER split AS p, count(*) FILTER (churn_probability >= 0.5) OVER split AS called,
          count(*) FILTER (churn_probability >= 0.5 AND churn = 1) OVER split AS tp
        FROM (SELECT dataset_split, churn, churn_probability,
                row_number() OVER (PARTITION BY dataset_split ORDER BY churn_probability) AS place FROM raw) placed
        WINDOW split AS (PARTITION BY dataset_split)) ranked_rows
  GROUP BY dataset_split, p, called, tp""",
)
def a18_by_split(t: Tables):
    """The metrics of every split, from one plan."""
    return rounded(binary_metrics(t.inputs, groups=["dataset_split"]), *METRICS)


@query(
    "s09_job_insert",
    f"""SELECT CAST(1 AS INTEGER) AS id, 'Churn prediction model' AS model_name, '1.0' AS model_version,
  'Gradient Boosting' AS algorithm, round(roc_auc, 6) AS roc_auc, round(f1_score, 6) AS f1_score,
  round(recall, 6) AS recall, 'running' AS status FROM {METRICS_SQL}""",
)
def s09(t: Tables):
    store = ResultStore(t.spark, t.scratch("job_insert"), t.buckets)
    store.create_job(binary_metrics(test_rows(t)).first().asDict())
    jobs = rounded(store.jobs(), "roc_auc", "f1_score", "recall")
    return jobs.select(
        "id", "model_name", "model_version", "algorithm", "roc_auc", "f1_score", "recall", "status"
    )


def rows_of(t: Tables, *splits: str):
    return prepare_features(t.customers.where(F.col("dataset_split").isin(*splits)))


def flags_sql(column: str) -> str:
    """One digit per category of the training rows, in alphabetical order."""
    return f"""(SELECT string_agg(CASE WHEN p.{column} = category THEN '1' ELSE '0' END, '' ORDER BY category)
    FROM (SELECT DISTINCT {column} AS category FROM prepared WHERE dataset_split = 'train') known)"""


@query(
    "m02_assembled_features",
    f"""SELECT customer_id, {' || '.join(flags_sql(c) for c in model.CATEGORICAL_FEATURES)} AS flags,
  {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in model.NUMERIC_FEATURES)} FROM prepared p""",
)
def m02(t: Tables):
    """Vectors fitted on the training rows, applied to every customer: the flags as digits, and the numbers."""
    fitted = Pipeline(stages=model.feature_stages()).fit(rows_of(t, "train"))
    assembled = fitted.transform(prepare_features(t.customers)).select(
        "customer_id", vector_to_array("features").alias("features")
    )
    numbers, size = model.NUMERIC_FEATURES, F.size("features")
    flags = F.slice("features", F.lit(1), size - len(numbers))
    return assembled.select(
        "customer_id",
        F.array_join(F.transform(flags, lambda f: f.cast("int").cast("string")), "").alias("flags"),
        *(F.get("features", size - len(numbers) + i).alias(name) for i, name in enumerate(numbers)),
    )


_FITTED: dict[tuple[str, str], object] = {}


def fitted(t: Tables):
    """The model of a data folder, fitted at most once per Spark application."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _FITTED:
        _FITTED[key] = model.train(rows_of(t, "train"))
    return _FITTED[key]


def planted(rows):
    """Rows whose label follows from one of their features."""
    return rows.withColumn("churn", (F.lower("voice_mail_plan") == "yes").cast("int"))


@query(
    "m03_model_metrics",
    """SELECT split AS dataset_split, TRUE AS within_bounds, TRUE AS learns
  FROM (VALUES ('train'), ('validation'), ('test')) splits(split)""",
)
def m03(t: Tables):
    """What must hold whatever the data: metrics are within bounds, and the trainer learns. A constant scorer has
    an area of one half on the training rows; a label that follows from a feature is found in rows not seen.
    """
    training = planted(rows_of(t, "train"))
    with ThreadPoolExecutor(2) as pool:  # the short jobs of one fit leave cores idle
        learner, known = pool.submit(model.train, training, rounds=10), pool.submit(fitted, t)
    told = learner.result()
    rows = rows_of(t, "train", "validation", "test")
    metrics = binary_metrics(model.score_customers(rows, known.result()), groups=["dataset_split"])
    found = binary_metrics(model.score_customers(planted(rows), told), groups=["dataset_split"])
    # A small split may hold one class only: its area is then unknown.
    within = [F.coalesce(F.col(m).between(0, 1), F.lit(m == "roc_auc")) for m in METRICS]
    learns = F.when(F.col("dataset_split") == "train", F.col("roc_auc") > 0.5).otherwise(F.col("told") == 1.0)
    return metrics.join(found.select("dataset_split", F.col("accuracy").alias("told")), "dataset_split").select(
        "dataset_split", reduce(and_, within).alias("within_bounds"), learns.alias("learns")
    )


@query(
    "m04_scored_customers",
    """SELECT customer_id, TRUE AS in_range, TRUE AS same_alone FROM raw
  WHERE dataset_split = 'scoring_batch'""",
)
def m04(t: Tables):
    """Probabilities are in range, and a customer's does not depend on who is scored beside it."""
    batch = rows_of(t, "scoring_batch")
    scored = model.score_customers(batch, fitted(t)).select("customer_id", "churn_probability")
    order = batch.repartition(3, "state").select(*batch.columns)
    again = model.score_customers(order, fitted(t)).select("customer_id", F.col("churn_probability").alias("again"))
    return scored.join(again, "customer_id").select(
        "customer_id",
        F.col("churn_probability").between(0, 1).alias("in_range"),
        (F.col("churn_probability") == F.col("again")).alias("same_alone"),
    )


@query(
    "m08_model_versions",
    """SELECT customer_id, CAST(2 AS INTEGER) AS version, TRUE AS as_before_saving FROM raw
  WHERE dataset_split = 'scoring_batch'""",
)
def m08(t: Tables):
    """Store the model twice; the latest version, loaded again, scores the batch as the fitted one does."""
    store = model.ModelStore(t.spark, t.scratch("models"))
    for _ in range(2):
        store.register(fitted(t))
    latest = store.latest()
    batch = rows_of(t, "scoring_batch")
    loaded = model.score_customers(batch, store.load(latest)).select("customer_id", "churn_probability")
    unsaved = model.score_customers(batch, fitted(t)).select("customer_id", F.col("churn_probability").alias("unsaved"))
    return loaded.join(unsaved, "customer_id").select(
        "customer_id",
        F.lit(latest.version).alias("version"),
        (F.col("churn_probability") == F.col("unsaved")).alias("as_before_saving"),
    )


@query(
    "m09_score_and_save",
    "SELECT customer_id, CAST(1 AS INTEGER) AS scoring_job_id, TRUE AS in_range, TRUE AS group_fits FROM raw "
    "WHERE dataset_split = 'scoring_batch'",
)
def m09(t: Tables):
    results = ResultStore(t.spark, t.scratch("run_results"), t.buckets)
    job = results.create_job({})
    rows = t.customers.where(F.col("dataset_split") == "scoring_batch")
    runs.score_and_save(rows, fitted(t), results, job)
    return published_checks(results)


def published_checks(results: ResultStore):
    p = F.col("churn_probability")
    group = F.when(p >= 0.7, "High").when(p >= 0.35, "Medium").otherwise("Low")
    return results.published()["predictions"].select(
        "customer_id",
        "scoring_job_id",
        p.between(0, 1).alias("in_range"),
        (F.col("risk_group") == group).alias("group_fits"),
    )


JOB_SQL = """SELECT CAST(1 AS INTEGER) AS id, 'success' AS status, count(*) AS predictions,
  count(*) AS segments, count(*) AS recommendations FROM raw WHERE dataset_split = 'scoring_batch'"""


def run_report(results: ResultStore):
    found = results.published()
    counts = {
        name: found[table].agg(F.count("*")).scalar()
        for name, table in (
            ("predictions", "predictions"),
            ("segments", "customer_segments"),
            ("recommendations", "customer_recommendations"),
        )
    }
    return results.jobs().select("id", "status").withColumns(counts)


@query("m10_scoring_run", JOB_SQL)
def m10(t: Tables):
    models = model.ModelStore(t.spark, t.scratch("models"))
    models.register(fitted(t))
    results = ResultStore(t.spark, t.scratch("run_results"), t.buckets)
    runs.run_scoring(t.customers, models, results)
    return run_report(results)


@query("m11_weekly_run", JOB_SQL)
def m11(t: Tables):
    models = model.ModelStore(t.spark, t.scratch("models"))
    results = ResultStore(t.spark, t.scratch("run_results"), t.buckets)
    runs.run_weekly(t.customers, models, results)
    return run_report(results)


# Synthetic customers


def draw_sql(name: str) -> str:
    block, slot = divmod(augment.DRAW_NAMES.index(name), draws.DRAWS_PER_DIGEST)
    return (
        f"(CAST('0x' || substr(md5('42:' || number || ':d{block}'), {1 + 8 * slot}, 8) AS BIGINT)"
        " / 4294967296.0::DOUBLE)"
    )


def minutes_sql(part: str) -> str:
    ratio = augment.MINUTE_JITTER[part]
    low, high = 1 - ratio, 1 + ratio
    return (
        f"CAST(format('{{:.1f}}', total_{part}_minutes * ({low!r}::DOUBLE + {high - low!r}::DOUBLE"
        f" * {draw_sql(part)})) AS DOUBLE)"
    )


def step_sql(column: str, delta: int, name: str, low: int) -> str:
    return (
        f"CAST(greatest({low}, {column} + CAST(floor({draw_sql(name)} * {2 * delta + 1}) AS INTEGER) - {delta})"
        " AS INTEGER)"
    )


def flip_sql(column: str, chance: float, name: str) -> str:
    return (
        f"CASE WHEN {draw_sql(name)} >= {chance} THEN {column}"
        f" WHEN lower({column}) IN ('yes', 'true', '1') THEN 'No' ELSE 'Yes' END"
    )


PARTS = ("day", "eve", "night", "intl")
PADDED = "chr(9) || voice_mail_plan || chr(10) || ' '"
SYNTHETIC = f"""batch AS (
  SELECT *, row_number() OVER (ORDER BY id) - 1 AS position FROM raw WHERE dataset_split = 'scoring_batch'
), wanted AS (
  SELECT number, CAST(floor(CAST('0x' || substr(md5('42:' || number || ':pick'), 1, 13) AS BIGINT)
    / 4503599627370496.0::DOUBLE * (SELECT count(*) FROM batch)) AS BIGINT) AS position
  FROM (SELECT unnest(range(1, 1 + 2 * (SELECT count(*) FROM batch))) AS number) numbers
), varied AS (
  SELECT number, state, area_code,
    {', '.join(f'{minutes_sql(p)} AS total_{p}_minutes' for p in PARTS)},
    {', '.join(f"{step_sql(f'total_{p}_calls', augment.CALL_JITTER[p], p + '_calls', 0)} AS total_{p}_calls" for p in PARTS)},
    {flip_sql('voice_mail_plan', 0.04, 'voice_flip')} AS voice_mail_plan,
    {flip_sql('international_plan', 0.03, 'intl_flip')} AS international_plan,
    {step_sql('number_vmail_messages', 4, 'messages', 1)} AS messages,
    {step_sql('account_length', 18, 'account', 1)} AS account_length,
    {step_sql('customer_service_calls', 1, 'service_calls', 0)} AS service_calls
  FROM wanted JOIN batch USING (position)
)"""
SYNTHETIC_ROWS = f"""SELECT 'SYN_' || CASE WHEN number < 100000 THEN lpad(CAST(number AS VARCHAR), 5, '0')
    ELSE CAST(number AS VARCHAR) END AS customer_id, 'scoring_batch' AS dataset_split, state, account_length,
  area_code, international_plan, voice_mail_plan,
  CAST(CASE WHEN lower(voice_mail_plan) IN ('yes', 'true', '1') THEN least(55, messages) ELSE 0 END AS INTEGER)
    AS number_vmail_messages,
  {', '.join(f'total_{p}_minutes, total_{p}_calls' for p in PARTS)},
  {', '.join(f"CAST(format('{{:.2f}}', total_{p}_minutes * {r}::DOUBLE) AS DOUBLE) AS total_{p}_charge" for p, r in (("day", "0.17"), ("eve", "0.085"), ("night", "0.045"), ("intl", "0.27")))},
  CAST(least(9, service_calls) AS INTEGER) AS customer_service_calls, CAST(NULL AS INTEGER) AS churn FROM varied"""


def augmented(t: Tables):
    """Three times the present scoring batch."""
    present = t.customers.where(F.col("dataset_split") == "scoring_batch").count()
    return augment.augment_scoring_customers(t.customers, 3 * present)


@query(
    "g01_augmented_batch",
    f"""SELECT customer_id, state FROM raw WHERE dataset_split = 'scoring_batch'
  UNION ALL SELECT customer_id, state FROM ({SYNTHETIC_ROWS}) made""",
    SYNTHETIC,
)
def g01(t: Tables):
    batch = t.customers.where(F.col("dataset_split") == "scoring_batch")
    made = augmented(t).customers
    return batch.select("customer_id", "state").unionByName(made.select("customer_id", "state"))


@query("g02_synthetic_rows", SYNTHETIC_ROWS, SYNTHETIC)
def g02(t: Tables):
    return augmented(t).customers


@query(
    "g03_jitter",
    f"""SELECT customer_id, {minutes_sql('day')} AS day_minutes,
  {step_sql('total_day_calls', 14, 'day_calls', 0)} AS day_calls,
  {flip_sql('voice_mail_plan', 0.04, 'voice_flip')} AS voice_mail_plan
  FROM (SELECT *, CAST(id AS BIGINT) AS number FROM raw) numbered_rows""",
)
def g03(t: Tables):
    """Every customer varied by draws from its own number."""
    varied = augment.synthetic_customers(
        t.customers.withColumns({"number": F.col("id").cast("bigint"), "source": F.col("customer_id")}), 42
    )
    return varied.select(
        F.col("source").alias("customer_id"),
        F.col("total_day_minutes").alias("day_minutes"),
        F.col("total_day_calls").alias("day_calls"),
        "voice_mail_plan",
    )


@query(
    "g03_padded_plan",
    f"""SELECT customer_id, {flip_sql('voice_mail_plan', 0.04, 'voice_flip')} AS voice_mail_plan
  FROM (SELECT * EXCLUDE (voice_mail_plan), trim({PADDED}, ' ' || chr(9) || chr(10)) AS voice_mail_plan,
    CAST(id AS BIGINT) AS number FROM raw) numbered_rows""",
)
def g03_padded(t: Tables):
    """Plan text loses all white space around it, not only blanks."""
    padded = F.concat(F.lit("\t"), F.col("voice_mail_plan"), F.lit("\n "))
    varied = augment.synthetic_customers(
        t.customers.withColumns(
            {"number": F.col("id").cast("bigint"), "source": F.col("customer_id"), "voice_mail_plan": padded}
        ),
        42,
    )
    return varied.select(F.col("source").alias("customer_id"), "voice_mail_plan")
