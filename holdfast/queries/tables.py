"""The logical tables, derived from the star schema and written once per session.

Customers are the star schema's customers, with usage taken from their orders and
a stand-in for the model's probability, so that results have an SQL counterpart.
Money, minutes and scores are whole numbers (cents, tenths of a minute, basis
points) until the last division.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast import schemas
from holdfast.functions import labels as L
from holdfast.operators import scoring
from holdfast.operators.features import prepare_features
from holdfast.operators.numbering import ordered_split
from holdfast.session import scratch_path
from holdfast.sources.buckets import buckets_for, read_bucketed, write_bucketed
from holdfast.sources.results import ResultStore

_INPUT_SCHEMA = T.StructType(
    [
        *schemas.CUSTOMERS.fields,
        T.StructField("churn_probability", T.DoubleType()),
        T.StructField("scoring_date", T.TimestampType()),
    ]
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def order_usage(orders: DataFrame) -> DataFrame:
    """Order counts and cents of each customer, combined before any join."""
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    parts = {
        "day": F.col("o_orderstatus") == "F",
        "eve": F.col("o_orderstatus") == "O",
        "night": F.col("o_orderstatus") == "P",
        "intl": F.col("o_orderpriority") == "5-LOW",
    }
    sums = []
    for part, chosen in parts.items():
        sums.append(F.count_if(chosen & cents.isNotNull()).alias(f"{part}_n"))
        sums.append(F.sum(F.when(chosen, cents)).alias(f"{part}_cents"))
    urgent = (F.col("o_orderpriority") == "1-URGENT") & cents.isNotNull()
    return orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count_if(urgent).alias("urgent"),
        *sums,
        F.max("o_orderdate").cast("timestamp").alias("scoring_date"),
    )


def derive_customers(customer: DataFrame, orders: DataFrame, nation: DataFrame) -> DataFrame:
    """One row per customer, without its split."""
    joined = customer.join(
        nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey"
    ).join(order_usage(orders), "c_custkey", "left")
    counts = ["urgent", *[f"{p}_{x}" for p in ("day", "eve", "night", "intl") for x in ("n", "cents")]]
    filled = joined.fillna(0, counts)
    cents_per_tenth = {"day": 15000, "eve": 12500, "night": 12500, "intl": 400000}
    rate = {"day": 170, "eve": 85, "night": 45, "intl": 270}
    tenths, charges = {}, {}
    for part, cents in cents_per_tenth.items():
        per_order = F.greatest(F.col(f"{part}_n"), F.lit(1)) * cents
        tenths[f"{part}_t"] = F.floor(F.col(f"{part}_cents") / per_order)
        charges[f"{part}_c"] = F.floor((F.col(f"{part}_t") * rate[part] + 50) / 100)
    k = F.col("c_custkey")
    machinery = F.col("c_mktsegment") == "MACHINERY"
    score = F.least(
        F.lit(9900),
        F.greatest(
            F.lit(100),
            300
            + 1400 * F.least(F.col("urgent"), F.lit(5))
            + F.when(F.col("day_c") >= 4000, 2600).otherwise(0)
            + F.when(machinery, 1500).otherwise(0)
            + (k * 7919) % 1000,
        ),
    )
    usage = filled.withColumns(tenths).withColumns(charges).withColumn("score_bp", score)

    def by_third(first: str, second: str, third: str):
        return F.when(k % 3 == 0, first).when(k % 3 == 1, second).otherwise(third)

    calls = {"day": 60 + k % 80, "eve": 60 + (k * 3) % 80, "night": 60 + (k * 7) % 80,
             "intl": F.col("intl_n")}
    measured = []
    for part in cents_per_tenth:
        measured += [
            (F.col(f"{part}_t") / 10).alias(f"total_{part}_minutes"),
            calls[part].cast("int").alias(f"total_{part}_calls"),
            (F.col(f"{part}_c") / 100).alias(f"total_{part}_charge"),
        ]
    return usage.select(
        (k + 1).cast("bigint").alias("id"),
        F.format_string("C%05d", k + 1).alias("customer_id"),
        F.lit(None).cast("string").alias("dataset_split"),
        F.col("n_name").alias("state"),
        (1 + (k * 37) % 240).cast("int").alias("account_length"),
        by_third("408", "415", "510").cast("int").alias("area_code"),
        F.when(machinery, by_third("Yes", "TRUE", "1"))
        .otherwise(by_third("No", "False", "0"))
        .alias("international_plan"),
        F.when(k % 4 == 0, "Yes").otherwise("No").alias("voice_mail_plan"),
        F.when(k % 4 == 0, 1 + k % 50).otherwise(0).cast("int").alias("number_vmail_messages"),
        *measured,
        F.col("urgent").cast("int").alias("customer_service_calls"),
        F.when((k * 7907) % 10000 < F.col("score_bp"), 1).otherwise(0).alias("churn"),
        (F.col("score_bp") / 10000).alias("churn_probability"),
        "scoring_date",
    )


def derive_jobs(orders: DataFrame) -> DataFrame:
    """One scoring job per order: its status, date and, for some, its metrics."""
    key, rank = F.col("o_orderkey"), F.col("o_orderpriority")
    known = rank.isin("1-URGENT", "2-HIGH")
    return orders.select(
        key.cast("int").alias("id"),
        F.lit("Churn prediction model").alias("model_name"),
        rank.alias("model_version"),
        F.lit("Gradient Boosting").alias("algorithm"),
        F.when(known, (key % 10000) / 10000).alias("roc_auc"),
        F.when(known, (key * 7 % 10000) / 10000).alias("f1_score"),
        F.when(rank == "1-URGENT", (key * 13 % 10000) / 10000).alias("recall"),
        F.when(rank != "5-LOW", 0.65).alias("high_risk_threshold"),
        F.when(rank != "4-NOT SPECIFIED", 0.3).alias("medium_risk_threshold"),
        F.when(F.col("o_orderstatus") == "F", "success")
        .when(F.col("o_orderstatus") == "O", "failed")
        .otherwise("running")
        .alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("scoring_date"),
    )


class Tables:
    """The logical tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def star(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    def scratch(self, name: str) -> str:
        return scratch_path(self.spark, name)

    @cached_property
    def buckets(self) -> int:
        return buckets_for(self.star("customer").count())

    @cached_property
    def inputs(self) -> DataFrame:
        """Customers with their split, stand-in probability and scoring date."""
        customer, nation = self.star("customer"), self.star("nation")
        derived = derive_customers(customer, self.star("orders"), nation)
        path = self.scratch("customers")
        write_bucketed(ordered_split(derived).select(*_INPUT_SCHEMA.names), path, self.buckets)
        return read_bucketed(self.spark, path, _INPUT_SCHEMA, self.buckets)

    @property
    def customers(self) -> DataFrame:
        return self.inputs.select(*schemas.CUSTOMERS.names)

    @property
    def scored(self) -> DataFrame:
        """Prepared customers of all splits with probability, risk group and factor."""
        return scoring.enrich_predictions(prepare_features(self.inputs))

    @cached_property
    def store(self) -> ResultStore:
        return ResultStore(self.spark, self.scratch("results"), self.buckets)

    @cached_property
    def results(self) -> dict[str, DataFrame]:
        """Published result tables. Some segments and recommendations are missing on
        purpose, so that outer joins meet customers without them."""
        scored = self.scored
        number = F.col("id")
        self.store.publish(
            self.store.create_job({}),
            scored,
            scoring.customer_segments(scored.where(number % 41 != 0)),
            scoring.customer_recommendations(scored.where(number % 37 != 0)),
        )
        return self.store.published()

    def searched(self, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The result tables, cut to the parts that a search can match."""
        found = self.results and self.store.published(search=text)
        return found["predictions"], found["customer_segments"], found["customer_recommendations"]

    @property
    def predictions(self) -> DataFrame:
        return self.results["predictions"]

    @property
    def segments(self) -> DataFrame:
        return self.results["customer_segments"]

    @property
    def recommendations(self) -> DataFrame:
        return self.results["customer_recommendations"]

    @property
    def result_tables(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self.predictions, self.segments, self.recommendations

    @property
    def jobs(self) -> DataFrame:
        return derive_jobs(self.star("orders"))

    # Tables that have drifted from the rules

    def _number(self):
        return F.substring("customer_id", 2, 12).cast("bigint")

    @property
    def drifted_predictions(self) -> DataFrame:
        wrong = F.when(self._number() % 29 == 0, L.DAY_FACTOR).otherwise(F.col("main_risk_factor"))
        return self.predictions.withColumn("main_risk_factor", wrong)

    @property
    def drifted_segments(self) -> DataFrame:
        wrong = F.when(self._number() % 31 == 0, 4).otherwise(F.col("segment_id"))
        return self.segments.withColumn("segment_id", wrong)

    @property
    def drifted_recommendations(self) -> DataFrame:
        number = self._number()
        return self.recommendations.withColumns(
            {
                "priority": F.when(number % 23 != 0, F.col("priority")),
                "recommendation_type": F.when(number % 43 == 0, L.NO_ACTION).otherwise(
                    F.col("recommendation_type")
                ),
            }
        )


_OPEN: dict[tuple[str, str], Tables] = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The tables of a folder, written at most once per Spark application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN:
        _OPEN[key] = Tables(spark, sf_dir)
    return _OPEN[key]
