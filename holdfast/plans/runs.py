"""End-to-end runs: score the batch with a stored model, or train first."""

from __future__ import annotations

from pyspark.sql import DataFrame

from holdfast.operators import scoring
from holdfast.operators.features import prepare_features
from holdfast.operators.quality import require_rows
from holdfast.plans.model import (
    ALGORITHM,
    MODEL_NAME,
    REGISTERED_NAME,
    ModelStore,
    ModelVersion,
    score_customers,
    train_and_register,
)
from holdfast.sources.customers import customers_in_splits
from holdfast.sources.results import ResultStore

TRAINING, VALIDATION, TEST, SCORING = "train", "validation", "test", "scoring_batch"


def _features(rows: DataFrame) -> DataFrame:
    return prepare_features(rows.drop("id", "dataset_split"))


def score_and_save(
    rows: DataFrame, model, results: ResultStore, job_id: int, customers: DataFrame | None = None
) -> None:
    """Score customers and publish predictions, segments and recommendations.

    The model runs once: segments do not depend on it, and recommendations are
    derived from the predictions as written. The bucket count is that of the whole
    customer table, so later joins with it need no shuffle.
    """
    require_rows(scoring=rows)
    features, buckets = _features(rows), results.bucket_count(rows if customers is None else customers)
    scored = scoring.enrich_predictions(score_customers(features, model))
    predictions = results.write_predictions(job_id, scored, buckets)
    folder = f"job_{job_id}"
    segments = scoring.customer_segments(features)
    results.write("customer_segments", folder, segments, buckets)
    recommendations = scoring.customer_recommendations(predictions)
    results.write("customer_recommendations", folder, recommendations, buckets)
    results.commit(job_id, folder, buckets)


def _run(
    customers: DataFrame,
    rows: DataFrame,
    models: ModelStore,
    version: ModelVersion | None,
    results: ResultStore,
    job: dict,
) -> int:
    """Score within a job; whatever goes wrong marks the job as failed."""
    job_id = results.create_job(job)
    try:
        score_and_save(rows, models.load(version), results, job_id, customers)
    except Exception:
        results.update_status(job_id, "failed")
        raise
    return job_id


def run_scoring(
    customers: DataFrame,
    models: ModelStore,
    results: ResultStore,
    version: ModelVersion | None = None,
    name: str = REGISTERED_NAME,
) -> int:
    """Score the scoring batch with a stored model, the latest by default."""
    rows = customers_in_splits(customers, [SCORING], ordered=False)
    require_rows(scoring=rows)
    version = version or models.latest(name)
    job = {
        "model_name": MODEL_NAME,
        "model_version": f"{version.name}/{version.version}" if version else f"{name}/latest",
        "algorithm": ALGORITHM,
    }
    return _run(customers, rows, models, version, results, job)


def run_weekly(
    customers: DataFrame, models: ModelStore, results: ResultStore, rounds: int = 100, seed: int = 42
) -> int:
    """Train, validate and test a new model, then score the scoring batch with it."""
    rows = {
        name: customers_in_splits(customers, [split], ordered=False)
        for name, split in (
            ("training", TRAINING), ("validation", VALIDATION), ("test", TEST), ("scoring", SCORING),
        )
    }
    require_rows(**rows)
    learnt = train_and_register(
        *[_features(rows[name]) for name in ("training", "validation", "test")],
        models,
        rounds=rounds,
        seed=seed,
    )
    return _run(customers, rows["scoring"], models, learnt["model"], results, learnt)
