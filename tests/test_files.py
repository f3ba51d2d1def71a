import csv as python_csv
import glob
import io
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from holdfast import schemas
from holdfast.operators import exports, reports
from holdfast.operators.filters import CustomerFilter
from holdfast.plans import runs
from holdfast.session import scratch_path
from holdfast.sources import csv
from holdfast.sources.buckets import buckets_for, read_bucketed, saved_by_customer, table_name, write_bucketed
from holdfast.sources.log import Log
from holdfast.sources.results import KeyViolation, ResultStore, Superseded, key_violations
from tests.helpers import prediction, predictions, recommendations, segments

HIGH = CustomerFilter(risk_group="High")


@pytest.fixture(scope="module")
def data(spark):
    return (
        predictions(spark, [prediction("C1", 0.905, "High", "High day charge", 80.0), prediction("C2")]),
        segments(spark, [("C1", 2, 'odd;"name" # line'), ("C2", 4, " Padded ")]),
        recommendations(spark, [("C1", "Tariff Optimization", None, "High")]),
    )


def written(path):
    parts = sorted(glob.glob(path.removeprefix("file:") + "/part-*.csv"))
    return [open(part, "rb").read() for part in parts]


def python_text(df):
    """What Python's csv module writes for the same rows."""
    out = io.StringIO()
    writer = python_csv.writer(out, delimiter=";", lineterminator="\r\n")
    writer.writerow(df.columns)
    writer.writerows(df.collect())
    return ("﻿" + out.getvalue()).encode()


def test_customer_file_bytes(spark, data):
    for chosen in (HIGH, CustomerFilter(search="c")):
        df = exports.filtered_customers(*data, chosen)
        path = scratch_path(spark, "customers")
        csv.write_report_csv(df, path, keep_empty=True, single_file=True)
        assert written(path) == [python_text(df)]


def test_customer_values(data):
    row = exports.filtered_customers(*data, HIGH).first().asDict()
    assert row["Вероятность оттока"] == f"{0.905:.2f}".replace(".", ",")
    assert row["Выручка под риском"] == "72,40"
    assert row["Дата прогноза"] == "06.05.2024"
    assert row["Рекомендация"] == "Оптимизация тарифа"
    assert row["Причина рекомендации"] == ""
    assert row["Приоритет"] == "Высокий"


def test_empty_files(spark, data):
    nobody = exports.filtered_customers(*data, CustomerFilter(search="nobody"), ["priority"])
    path = scratch_path(spark, "nobody")
    csv.write_report_csv(nobody, path, keep_empty=True)
    assert written(path) == ["﻿ID клиента;Приоритет\r\n".encode()]
    nothing = exports.recommendations_export(
        reports.cells(
            data[0].join(data[2], "customer_id").limit(0), "recommendation_type", "recommendation_reason",
            "priority", "main_risk_factor", "risk_group",
        )
    )
    path = scratch_path(spark, "nothing")
    csv.write_report_csv(nothing, path, keep_empty=False)
    assert written(path) == []


def test_export_fields_keep_file_order():
    assert exports.export_fields(["priority", "risk_group"]) == ["customer_id", "risk_group", "priority"]
    assert len(exports.export_fields(None)) == len(exports.export_fields([])) == 11


def test_dashboard_export_of_nothing(spark):
    nothing = predictions(spark, []), segments(spark, []), recommendations(spark, [])
    assert [tuple(r)[2] for r in exports.dashboard_export(*nothing).collect()] == ["0", "", "", "", ""]


def test_dashboard_export_order(data):
    rows = exports.dashboard_export(*data).collect()
    assert [r["Раздел"] for r in rows] == ["KPI"] * 5 + ["Распределение риска"] * 2 + ["Сводка рекомендаций"]
    assert [r["Показатель"] for r in rows[5:7]] == ["Высокий риск", "Средний риск"]


def test_column_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], [" Total Day-Charge ", "ID", "x_y"])
    assert csv.normalize_columns(df).columns == ["total_day_charge", "id", "x_y"]


def test_landing_appends(spark):
    path = scratch_path(spark, "landing")
    for _ in range(2):
        csv.append_landing(spark.range(3), path)
    assert spark.read.parquet(path).count() == 6


# Result store


@pytest.fixture
def store(spark):
    return ResultStore(spark, scratch_path(spark, "results"), 4)


def test_nothing_published(store):
    assert all(df.isEmpty() for df in store.published().values())
    assert store.jobs().isEmpty()
    store.update_status(5, "failed")
    assert store.jobs().isEmpty()


def test_readers_see_whole_runs_only(store, data):
    first = store.create_job({"roc_auc": 0.9})
    store.publish(first, *data)
    second = store.create_job({"model_version": "2"})
    assert (first, second) == (1, 2)
    store.write_predictions(second, data[0].limit(1), 4)
    assert store.published()["predictions"].count() == 2
    store.update_status(second, "failed")
    assert {r["id"]: r["status"] for r in store.jobs().collect()} == {1: "success", 2: "failed"}
    assert {r["scoring_job_id"] for r in store.published()["predictions"].collect()} == {1}
    third = store.create_job({})
    store.publish(third, data[0].limit(1), data[1].limit(0), data[2])
    found = store.published()
    assert found["predictions"].count() == 1 and found["customer_segments"].isEmpty()


def test_predictions_carry_the_jobs_time(store, data):
    job = store.create_job({})
    written = store.write_predictions(job, data[0].drop("scoring_date", "scoring_job_id"), 4)
    when = store.jobs().first()["scoring_date"]
    assert {r["scoring_date"] for r in written.collect()} == {when}


def test_unknown_job_is_refused(store, data):
    with pytest.raises(ValueError, match="Unknown scoring job"):
        store.publish(9, *data)


def test_amend(store, data):
    with pytest.raises(ValueError, match="no results"):
        store.amend({})
    job = store.create_job({})
    store.publish(job, *data)
    tables = store.published()
    changed = tables["customer_segments"].withColumn("segment_id", F.lit(3))
    store.amend({**tables, "customer_segments": changed})
    assert {r["segment_id"] for r in store.published()["customer_segments"].collect()} == {3}
    assert store.published()["predictions"].count() == 2
    assert store.jobs().count() == 1


def test_other_sessions_read_the_buckets(spark, store, data):
    store.publish(store.create_job({}), *data)
    before = store.published()["predictions"].collect()
    for table in ("predictions", "customer_segments", "customer_recommendations"):
        spark.sql(f"DROP TABLE {table_name(f'{store.root}/{table}/job_1')}")
    again = ResultStore(spark, store.root, 16).published()
    assert sorted(again["predictions"].collect()) == sorted(before)
    plan = again["predictions"].join(again["customer_segments"], "customer_id")
    assert plan.count() == 2


def test_failed_run_keeps_old_results(spark, store, data):
    store.publish(store.create_job({}), *data)

    class NoModels:
        def load(self, version):
            raise RuntimeError("no model")

    rows = spark.createDataFrame([("C9", "x")], "customer_id string, dataset_split string")
    with pytest.raises(RuntimeError):
        runs._run(rows, rows, NoModels(), None, store, {})
    assert {r["id"]: r["status"] for r in store.jobs().collect()} == {1: "success", 2: "failed"}
    assert store.published()["predictions"].count() == 2


def test_bucket_count_follows_the_rows(spark):
    assert [buckets_for(n) for n in (0, 10**6, 32_000_001)] == [8, 8, 9]
    assert buckets_for(10**12, most=250_000) == 250_000 and buckets_for(5, least=2) == 2
    with pytest.raises(ValueError, match="250000 buckets"):
        buckets_for(10**12)
    assert ResultStore(spark, "unused").bucket_count(spark.range(5)) == 8


def test_vacuum_keeps_what_is_published(spark, store, data):
    for _ in range(3):
        store.publish(store.create_job({}), *data)
    tables = store.published()
    changed = {**tables, "customer_segments": tables["customer_segments"].withColumn("segment_id", F.lit(1))}
    store.amend(changed)
    before = sorted(store.published()["predictions"].collect())
    assert store.vacuum(keep=2) == ["job_2", "job_1"]
    # The amendment still reads the predictions of the run it amended.
    assert store.vacuum() == []
    assert sorted(store.published()["predictions"].collect()) == before
    assert not spark.catalog.tableExists(table_name(f"{store.root}/predictions/job_2"))
    store.publish(store.create_job({}), *data)
    gone = store.vacuum()
    assert len(gone) == 2 and gone[1] == "job_3" and gone[0].startswith("job_3_amended_") and store.vacuum() == []
    assert not os.path.exists(f"{store.root}/predictions/job_3")
    assert sorted(r["customer_id"] for r in store.published()["predictions"].collect()) == ["C1", "C2"]
    with pytest.raises(ValueError):
        store.vacuum(keep=0)


def stored_files(df):
    return {r["f"] for r in df.select(F.input_file_name().alias("f")).distinct().collect()}


def test_amendment_keeps_the_files_of_unchanged_buckets(spark, store):
    ids = [f"C{k}" for k in range(40)]
    rows = (
        predictions(spark, [prediction(i) for i in ids]),
        segments(spark, [(i, 4, "Stable") for i in ids]),
        recommendations(spark, [(i, "No Action", None, "Low") for i in ids]),
    )
    store.publish(store.create_job({}), *rows)
    before = store.published()
    files = {name: stored_files(df) for name, df in before.items()}
    assert all(len(f) == 4 for f in files.values())
    one = F.col("customer_id") == "C7"
    store.amend({**before, "customer_segments": before["customer_segments"].withColumn("segment_id", F.when(one, 2).otherwise(F.col("segment_id")))})
    after = store.published()
    assert len(stored_files(after["customer_segments"]) & files["customer_segments"]) == 3
    assert stored_files(after["predictions"]) == files["predictions"]
    assert {r["segment_id"] for r in after["customer_segments"].where(one).collect()} == {2}
    assert after["customer_segments"].count() == 40
    # Rows may also be removed and added; joins of amended tables are not shuffled.
    store.amend({**after, "customer_recommendations": after["customer_recommendations"].where("customer_id != 'C7'")})
    last = store.published()
    assert last["customer_recommendations"].count() == 39
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = last["predictions"].join(last["customer_segments"], "customer_id")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in joined and "Exchange" not in joined
        violations = key_violations(last)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in violations
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_runs_with_broken_keys_are_refused(store, data):
    p, s, r = data
    store.publish(store.create_job({}), *data)
    broken = [(p.union(p), s, r), (p, s.union(s.limit(1)), r), (p.where("customer_id = 'C1'"), s, r)]
    for tables in broken:
        with pytest.raises(KeyViolation, match="predictions|segments|recommendations"):
            store.publish(store.create_job({}), *tables)
    assert store.published()["predictions"].count() == 2
    assert {r["scoring_job_id"] for r in store.published()["predictions"].collect()} == {1}


def test_writers_at_once(spark, store, data):
    """Ids, folders and log entries of runs that write at once are their own, and one run is seen whole."""
    from concurrent.futures import ThreadPoolExecutor

    def run(k):
        own = ResultStore(spark, store.root, 4)
        job = own.create_job({})
        own.publish(job, *(df.withColumn("customer_id", F.concat("customer_id", F.lit(f"of{job}"))) for df in data))
        return job

    with ThreadPoolExecutor(4) as pool:
        assert sorted(pool.map(run, range(4))) == [1, 2, 3, 4]
    revisions = sorted(r["revision"] for r in store.log().collect())
    assert revisions == list(range(1, 9))
    last = store.log().orderBy(F.desc("revision")).first()["id"]
    for df in store.published().values():
        assert {r["customer_id"].split("of")[1] for r in df.collect()} == {str(last)}


def test_amendments_of_superseded_results_are_refused(store, data):
    store.publish(store.create_job({}), *data)
    with pytest.raises(Superseded):
        with store.amending() as save:
            for name, df in store.published().items():
                save(name, df)
            store.publish(store.create_job({}), *data)
    assert {r["scoring_job_id"] for r in store.published()["predictions"].collect()} == {2}


def test_log_numbers_are_taken_once(spark):
    from concurrent.futures import ThreadPoolExecutor

    schema = StructType(schemas.SCORING_JOBS.fields[:1]).add("revision", "long")
    path, made = scratch_path(spark, "log"), []
    log = Log(spark, path, schema)
    assert log.rows().isEmpty() and log.append(lambda rows: None) is None
    with ThreadPoolExecutor(4) as pool:
        made = list(pool.map(lambda k: Log(spark, path, schema).append(lambda rows: {"id": rows.count()}), range(8)))
    assert sorted((m["revision"], m["id"]) for m in made) == [(k + 1, k) for k in range(8)]
    assert not log._create(8, "{}") and log.rows().count() == 8


def test_half_an_amendment_is_not_shown(store, data):
    store.publish(store.create_job({}), *data)
    before = sorted(store.published()["predictions"].collect())
    with pytest.raises(ValueError, match="not amended"):
        with store.amending() as save:
            save("predictions", store.published()["predictions"].limit(0))
    assert sorted(store.published()["predictions"].collect()) == before


def test_registrations_that_no_longer_fit_are_replaced(spark, store, data):
    path = scratch_path(spark, "predictions")
    write_bucketed(data[0], path, 4)
    assert read_bucketed(spark, path, StructType(schemas.PREDICTIONS.fields[:1]), 16).columns == ["customer_id"]
    assert read_bucketed(spark, path, schemas.PREDICTIONS, 16).columns == schemas.PREDICTIONS.names
    assert read_bucketed(spark, path, schemas.PREDICTIONS, 16).count() == 2


def test_scratch_tables_leave_the_catalogue(spark, data):
    """Rows and buckets are still known after the entry is gone, also in a join and when read twice."""
    before = {t.name for t in spark.catalog.listTables()}
    left, right = (saved_by_customer(df, 4) for df in data[:2])
    assert {t.name for t in spark.catalog.listTables()} == before
    joined = left.join(right.hint("merge"), "customer_id")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    for _ in range(2):
        assert {r["customer_id"]: r["segment_id"] for r in joined.collect()} == {"C1": 2, "C2": 4}
