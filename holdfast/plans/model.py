"""Churn model: features, training, scoring, metrics and stored versions."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.operators.metrics import NO_ROWS, binary_metrics
from holdfast.operators.quality import require_label
from holdfast.schemas import CUSTOMERS
from holdfast.session import checkpoint_root
from holdfast.sources.log import Log

# Features are all columns of a customer but ids, split and label: texts are categories.
_FEATURES = [f for f in CUSTOMERS if f.name not in ("id", "customer_id", "dataset_split", "churn")]
NUMERIC_FEATURES = tuple(f.name for f in _FEATURES if f.dataType != T.StringType())
CATEGORICAL_FEATURES = tuple(f.name for f in _FEATURES if f.dataType == T.StringType())

# Names under which models and their jobs are listed.
ALGORITHM = "Gradient Boosting"
MODEL_NAME = "Churn prediction model"
REGISTERED_NAME = "churn_prediction_model"


# Rows that one task of a fit reads and holds in memory. Every round is several short jobs, whose cost grows with
# the square of the partitions: beyond ``PARTITIONS`` they get larger, up to ten times so many rows.
ROWS_PER_PARTITION = 50_000
PARTITIONS = 128


def feature_stages() -> list:
    """One-hot categories (an unknown one is all zeros) beside the plain numbers."""
    indexed = [f"{c}__index" for c in CATEGORICAL_FEATURES]
    flags = [f"{c}__flags" for c in CATEGORICAL_FEATURES]
    return [
        StringIndexer(inputCols=list(CATEGORICAL_FEATURES), outputCols=indexed, handleInvalid="keep",
                      stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=indexed, outputCols=flags),
        VectorAssembler(inputCols=[*flags, *NUMERIC_FEATURES], outputCol="features"),
    ]


def in_canonical_layout(rows: DataFrame, rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """The same rows, placed and ordered by their values alone: a fit sums and samples per partition.

    Rows with the same values may change places, which changes nothing.
    """
    count = rows.count()
    size = max(rows_per_partition, min(10 * rows_per_partition, -(-count // PARTITIONS)))
    partitions = max(1, -(-count // size))
    placed = rows.repartition(1) if partitions == 1 else rows.repartition(partitions, F.xxhash64(*rows.columns))
    return placed.sortWithinPartitions(*rows.columns)


def train(training: DataFrame, rounds: int = 100, seed: int = 42) -> PipelineModel:
    """Fit gradient-boosted trees: depth 3, learning rate 0.1, one tree per round.

    The trees depend on the rows and the seed, not on how the rows are stored.
    """
    checkpoint_root(training.sparkSession)
    booster = GBTClassifier(
        featuresCol="features",
        labelCol="label",
        maxIter=rounds,
        maxDepth=3,
        stepSize=0.1,
        maxBins=64,
        seed=seed,
    )
    labelled = training.select(
        *CATEGORICAL_FEATURES, *NUMERIC_FEATURES, F.col("churn").cast("double").alias("label")
    )
    placed = in_canonical_layout(labelled)
    features = Pipeline(stages=feature_stages()).fit(placed)
    # Kept in files, partition by partition: features are made once, and the tasks of the several short jobs of a
    # round need not carry the steps that made them.
    assembled = features.transform(placed).select("features", "label").checkpoint()
    return PipelineModel([*features.stages, booster.fit(assembled)])


def score_customers(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Add ``churn_probability``; the model's working columns are dropped."""
    scored = model.transform(df)
    return scored.select(
        *df.columns, vector_to_array("probability")[1].alias("churn_probability")
    )


VERSION_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("path", T.StringType()),
        T.StructField("revision", T.LongType()),
    ]
)


@dataclass(frozen=True)
class ModelVersion:
    name: str
    version: int
    path: str


class ModelStore:
    """Fitted models in folders of their own, with a log of the versions that several writers may add to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._log = Log(spark, f"{self.root}/versions", VERSION_SCHEMA)

    def versions(self) -> DataFrame:
        return self._log.rows().drop("revision")

    def register(self, model: PipelineModel, name: str = REGISTERED_NAME) -> ModelVersion:
        """Save the model, then add its version: a version listed can always be loaded."""
        path = f"{self.root}/{name}/model_{uuid.uuid4().hex[:12]}"
        model.write().save(path)

        def entry(rows: DataFrame) -> dict:
            known = rows.where(F.col("name") == name).agg(F.max("version")).first()[0] or 0
            return {"name": name, "version": known + 1, "path": path}

        return ModelVersion(name, self._log.append(entry)["version"], path)

    def latest(self, name: str = REGISTERED_NAME) -> ModelVersion | None:
        row = self.versions().where(F.col("name") == name).orderBy(F.desc("version")).first()
        return ModelVersion(row["name"], row["version"], row["path"]) if row else None

    def load(self, entry: ModelVersion | None) -> PipelineModel:
        if entry is None:
            raise ValueError("No model version is registered.")
        return PipelineModel.load(entry.path)


def train_and_register(
    training: DataFrame,
    validation: DataFrame,
    test: DataFrame,
    store: ModelStore,
    name: str = REGISTERED_NAME,
    rounds: int = 100,
    seed: int = 42,
) -> dict:
    """Fit on the training rows, measure on the other two in one plan, and store the model."""
    require_label(training=training, validation=validation, test=test)
    model = train(training, rounds, seed)

    def scored(df: DataFrame, part: str) -> DataFrame:
        return score_customers(df, model).select("churn", "churn_probability", F.lit(part).alias("part"))

    both = scored(validation, "validation").unionByName(scored(test, "test"))
    measured = {row["part"]: row.asDict() for row in binary_metrics(both, groups=["part"]).collect()}
    validation_metrics, test_metrics = (
        {metric: measured.get(part, NO_ROWS)[metric] for metric in NO_ROWS} for part in ("validation", "test")
    )
    entry = store.register(model, name)
    return {
        "model": entry,
        "registered_model_name": name,
        "model_name": MODEL_NAME,
        "model_version": str(entry.version),
        "algorithm": ALGORITHM,
        **test_metrics,
        "validation_metrics": validation_metrics,
    }
