import pytest
from pyspark.sql import functions as F

from holdfast.operators.features import prepare_features
from holdfast.plans import model, runs
from holdfast.session import scratch_path
from holdfast.sources.results import ResultStore
from tests.helpers import one

SF_01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def customers(spark):
    from holdfast.queries.tables import tables

    return tables(spark, SF_01).customers


@pytest.fixture(scope="module")
def parts(customers):
    rows = prepare_features(customers).cache()
    return {s: rows.where(F.col("dataset_split") == s) for s in ("train", "validation", "test", "scoring_batch")}


@pytest.fixture(scope="module")
def fitted(parts):
    return model.train(parts["train"], rounds=10)


def test_probabilities_and_auc(parts, fitted):
    scored = model.score_customers(parts["test"], fitted)
    low, high = scored.agg(F.min("churn_probability"), F.max("churn_probability")).first()
    assert 0 <= low < high <= 1
    metrics = one(model.binary_metrics(scored))
    constant = one(model.binary_metrics(scored.withColumn("churn_probability", F.lit(0.3))))
    assert metrics["roc_auc"] > 0.6 and constant["roc_auc"] == pytest.approx(0.5)
    assert constant["f1_score"] == constant["recall"] == constant["precision"] == 0.0


def test_same_seed_same_model(parts, fitted):
    again = model.train(parts["train"], rounds=10)
    first, second = (
        {r["customer_id"]: r["churn_probability"] for r in model.score_customers(parts["test"], m).collect()}
        for m in (fitted, again)
    )
    assert first == pytest.approx(second)


def test_unseen_category_is_accepted(parts, fitted):
    odd = parts["test"].withColumns({"state": F.lit("ELSEWHERE"), "voice_mail_plan": F.lit("none")})
    assert model.score_customers(odd, fitted).where("churn_probability IS NULL").isEmpty()


def test_metrics_with_ties_and_one_class(spark):
    rows = [(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1), (1, 0.1)]
    found = one(model.binary_metrics(spark.createDataFrame(rows, "churn int, churn_probability double")))
    pairs = [(p > n) + 0.5 * (p == n) for l1, p in rows if l1 for l0, n in rows if not l0]
    assert found["roc_auc"] == pytest.approx(sum(pairs) / len(pairs))
    assert found["recall"] == pytest.approx(2 / 3) and found["precision"] == pytest.approx(2 / 3)
    assert found["accuracy"] == pytest.approx(3 / 5)
    alone = one(model.binary_metrics(spark.createDataFrame([(1, 0.5), (1, 0.7)], "churn int, churn_probability double")))
    assert alone["roc_auc"] is None


def test_label_is_required(spark, parts):
    store = model.ModelStore(spark, scratch_path(spark, "models"))
    with pytest.raises(ValueError, match="validation dataset"):
        model.train_and_register(parts["train"], parts["validation"].drop("churn"), parts["test"], store)


def test_versions(spark, parts, fitted):
    store = model.ModelStore(spark, scratch_path(spark, "models"))
    assert store.latest() is None
    store.register(fitted)
    store.register(fitted, "other")
    assert store.register(fitted).version == 2
    assert (store.latest().version, store.latest("other").version) == (2, 1)
    loaded = store.load(store.latest())
    left = model.score_customers(parts["test"], loaded).orderBy("customer_id").collect()
    assert left == model.score_customers(parts["test"], fitted).orderBy("customer_id").collect()


def test_weekly_then_scoring_run(spark, customers):
    models = model.ModelStore(spark, scratch_path(spark, "models"))
    results = ResultStore(spark, scratch_path(spark, "results"), 4)
    assert runs.run_weekly(customers, models, results, rounds=5) == 1
    job = one(results.jobs())
    assert job["status"] == "success" and 0 < job["roc_auc"] <= 1 and job["model_version"] == "1"
    found = results.published()
    assert {name: df.count() for name, df in found.items()} == dict.fromkeys(found, 150)
    assert found["predictions"].where("scoring_date IS NULL OR scoring_job_id <> 1").isEmpty()
    assert runs.run_scoring(customers, models, results) == 2
    second = results.jobs().where("id = 2").first()
    assert second["roc_auc"] is None and second["model_version"] == "churn_prediction_model/1"
    again = results.published()["predictions"].select("customer_id", "churn_probability")
    assert again.exceptAll(found["predictions"].select("customer_id", "churn_probability")).isEmpty()


def test_empty_splits_are_refused(spark, customers):
    models = model.ModelStore(spark, scratch_path(spark, "models"))
    results = ResultStore(spark, scratch_path(spark, "results"), 4)
    with pytest.raises(ValueError, match="Validation data is empty"):
        runs.run_weekly(customers.where("dataset_split <> 'validation'"), models, results)
    with pytest.raises(ValueError, match="Scoring data is empty"):
        runs.run_scoring(customers.where("dataset_split = 'train'"), models, results)
    assert results.jobs().isEmpty()
    with pytest.raises(ValueError, match="No model version"):
        runs.run_scoring(customers, models, results)
    failed = one(results.jobs())
    assert (failed["status"], failed["model_version"]) == ("failed", "churn_prediction_model/latest")


def test_trees_do_not_depend_on_the_layout(spark, logical):
    rows = prepare_features(logical.customers.where("dataset_split = 'train'"))
    trees = set()
    for partitions in (1, 3, 8):
        fitted = model.train(rows.repartition(partitions, "state"), rounds=5)
        trees.add(fitted.stages[-1].toDebugString.split("\n", 1)[1])
    assert len(trees) == 1


def test_versions_of_writers_at_once(spark, logical):
    from concurrent.futures import ThreadPoolExecutor

    from holdfast.session import scratch_path

    fitted = model.train(prepare_features(logical.customers.where("dataset_split = 'train'")), rounds=1)
    root = scratch_path(spark, "models")
    with ThreadPoolExecutor(3) as pool:
        made = list(pool.map(lambda k: model.ModelStore(spark, root).register(fitted), range(3)))
    assert sorted(m.version for m in made) == [1, 2, 3] and len({m.path for m in made}) == 3
    assert model.ModelStore(spark, root).latest().version == 3


def test_tasks_of_a_fit_stay_small(spark):
    rows = spark.range(230_000).select((F.col("id") % 9_973).alias("x"), F.col("id").cast("double").alias("y"))
    placed = model.in_canonical_layout(rows)
    sizes = [r["n"] for r in placed.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 5 and sum(sizes) == 230_000 and max(sizes) < 60_000
    assert placed.exceptAll(rows).isEmpty() and rows.exceptAll(placed).isEmpty()
    # Very many rows: more rows a task rather than ever more tasks, up to ten times as many.
    assert model.in_canonical_layout(rows, 1_000).rdd.getNumPartitions() == 128
    assert model.in_canonical_layout(rows, 100).rdd.getNumPartitions() == 230


def test_trees_do_not_depend_on_the_layout_with_several_tasks(spark, logical):
    rows = prepare_features(logical.customers.where("dataset_split = 'train'"))
    many = rows.crossJoin(spark.range(800).select("id").withColumnRenamed("id", "copy"))
    many = many.withColumn("account_length", (F.col("account_length") + F.col("copy")).cast("int")).drop("copy")
    assert many.count() > model.ROWS_PER_PARTITION
    probabilities = []
    for partitions in (2, 5):
        fitted = model.train(many.repartition(partitions, "state"), rounds=3)
        scored = model.score_customers(rows, fitted).select("customer_id", "churn_probability")
        probabilities.append({r[0]: r[1] for r in scored.collect()})
    assert probabilities[0] == pytest.approx(probabilities[1])


def test_rounds_do_not_repeat_the_steps_before_them(spark, logical, monkeypatch):
    rows = prepare_features(logical.customers.where("dataset_split = 'train'"))
    given, fit = [], model.GBTClassifier.fit
    monkeypatch.setattr(model.GBTClassifier, "fit", lambda self, df: given.append(df) or fit(self, df))
    fitted = model.train(rows, rounds=3)
    plan = given[0]._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" in plan and not any(step in plan for step in ("Exchange", "Sort", "UDF", "FileScan"))
    # Features keep what is known of them (flags have two values), so the trees are those of a fit without files.
    labelled = rows.select(
        *model.CATEGORICAL_FEATURES, *model.NUMERIC_FEATURES, F.col("churn").cast("double").alias("label")
    )
    booster = model.GBTClassifier(featuresCol="features", labelCol="label", maxIter=3, maxDepth=3, stepSize=0.1, maxBins=64, seed=42)
    whole = model.Pipeline(stages=[*model.feature_stages(), booster]).fit(model.in_canonical_layout(labelled))
    trees = [m.stages[-1].toDebugString.split("\n", 1)[1] for m in (fitted, whole)]
    assert trees[0] == trees[1] and " in {" in trees[0]
    assert [type(s) for s in fitted.stages] == [type(s) for s in whole.stages]
