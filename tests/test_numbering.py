import random

import pytest
from pyspark.sql import functions as F

from holdfast.operators import numbering
from holdfast.session import scratch_path


@pytest.mark.parametrize("kind, low, high", [("int", 0, 5000), ("int", -(2**31), 2**31 - 1), ("bigint", -(2**62), 2**62)])
def test_keys_at_ranks(spark, kind, low, high):
    source = random.Random(3)
    keys = sorted({source.randint(low, high) for _ in range(700)})
    df = spark.createDataFrame([(k,) for k in source.sample(keys, len(keys))], f"id {kind}").repartition(5)
    ranks = [0, 1, 2, len(keys) // 3, len(keys) - 1, len(keys)]
    found = numbering.keys_at_ranks(df, "id", ranks)
    assert found == {r: keys[r - 1] for r in ranks if r}


def test_keys_at_ranks_with_repeats(spark):
    keys = [5] * 300 + [7] + [9] * 100
    df = spark.createDataFrame([(k,) for k in keys], "id bigint")
    assert numbering.keys_at_ranks(df, "id", [1, 300, 301, 302, 401]) == {1: 5, 300: 5, 301: 7, 302: 9, 401: 9}


@pytest.mark.parametrize("count", [1, 3, 7, 20, 103])
def test_split_by_rank(spark, count):
    source = random.Random(count)
    ids = sorted(source.sample(range(10**6), count))
    df = spark.createDataFrame([(i,) for i in ids], "id int").repartition(3)
    found = {r["id"]: r["dataset_split"] for r in numbering.ordered_split(df).collect()}
    for place, i in enumerate(ids, start=1):
        share = place * 100
        expected = (
            "train" if share <= 60 * count else "validation" if share <= 75 * count
            else "test" if share <= 90 * count else "scoring_batch"
        )
        assert found[i] == expected


def test_existing_split_is_kept_but_counts(spark):
    df = spark.createDataFrame([(i, "mine" if i <= 5 else None) for i in range(1, 11)], "id int, dataset_split string")
    found = [r["dataset_split"] for r in numbering.ordered_split(df).orderBy("id").collect()]
    assert found == ["mine"] * 5 + ["train", "validation", "test", "test", "scoring_batch"]


def test_numbers_follow_the_order(spark):
    values = random.Random(5).sample(range(10**6), 2000)
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(7)
    found = {r["v"]: r["n"] for r in numbering.numbered(df, ["v"], "n").collect()}
    assert found == {v: n for n, v in enumerate(sorted(values), start=1)}


def test_stored_order_numbers_every_row_once(spark):
    df = spark.range(1000).repartition(7)
    found = sorted(r["n"] for r in numbering.numbered(df, None, "n", start=0).collect())
    assert found == list(range(1000))


def test_id_backfill(spark):
    df = spark.createDataFrame([(None, "c"), (10, "a"), (None, "b")], "id int, customer_id string")
    after = {r["customer_id"]: r["id"] for r in numbering.backfill_ids(df, ["customer_id"]).collect()}
    assert after == {"a": 10, "b": 11, "c": 12}
    restarted = numbering.backfill_ids(df, ["customer_id"], start=1)
    assert {r["customer_id"]: r["id"] for r in restarted.collect()} == {"a": 10, "b": 1, "c": 2}
    assert dict(restarted.dtypes)["id"] == "int"


def test_last_synthetic_number(spark):
    def last(*ids):
        df = spark.createDataFrame([(i,) for i in ids], "customer_id string")
        return numbering.last_synthetic_number(df).first()["last_number"]

    assert last("C00001", "SYNX00009") == 0
    assert last("SYN_00007", "SYN_00012", "C99999") == 12
    assert last("SYN_123456") == 123456


def test_split_counts(spark):
    df = spark.range(10).withColumn("dataset_split", F.when(F.col("id") < 4, "train").otherwise("test"))
    assert {r[0]: r[1] for r in numbering.split_counts(df).collect()} == {"train": 4, "test": 6}


def test_ids_beyond_32_bits_are_split_and_filled(spark):
    big = 2**40
    rows = spark.createDataFrame([(big + i,) for i in range(100)], "id bigint")
    found = {r["id"] - big: r["dataset_split"] for r in numbering.ordered_split(rows).collect()}
    assert [found[i] for i in (0, 59, 60, 74, 75, 89, 90, 99)] == [
        "train", "train", "validation", "validation", "test", "test", "scoring_batch", "scoring_batch"
    ]
    gaps = spark.createDataFrame([(big, "a"), (None, "b")], "id bigint, customer_id string")
    assert {r["id"] for r in numbering.backfill_ids(gaps, ["customer_id"]).collect()} == {big, big + 1}


def test_rows_without_a_key_rank_last(spark):
    """80 of 100 rows have a key: the limit at rank 90 lies among those without."""
    rows = spark.createDataFrame([(i if i < 80 else None,) for i in range(100)], "id bigint")
    found = [(r["id"], r["dataset_split"]) for r in numbering.ordered_split(rows).collect()]
    counts = {}
    for key, split in found:
        counts[key is None, split] = counts.get((key is None, split), 0) + 1
    assert counts == {(False, "train"): 60, (False, "validation"): 15, (False, "test"): 5, (True, "scoring_batch"): 20}


@pytest.mark.parametrize("kept", ["true", "key % 3 = 0", "key % 100 >= 50", "false"])
def test_numbers_as_stored(spark, kept):
    """Places in files hold whatever filters leave; blocks are smaller than files."""
    path = scratch_path(spark, "stored")
    spark.range(1000).withColumnRenamed("id", "key").repartitionByRange(5, "key").sortWithinPartitions("key").write.parquet(path)
    rows = spark.read.parquet(path).where(kept)
    found = numbering.numbered_as_stored(rows, "n", start=10, block_rows=64).orderBy("n").collect()
    assert [r["n"] for r in found] == list(range(10, 10 + rows.count()))
    assert [r["key"] for r in found] == sorted(r["key"] for r in rows.collect())


def test_whole_files_are_numbered_without_a_move(spark):
    path = scratch_path(spark, "whole")
    spark.range(1000).repartition(4).write.parquet(path)
    plan = numbering.numbered_as_stored(spark.read.parquet(path), "n")._jdf.queryExecution().executedPlan().toString()
    scanned_rows = plan.split("BroadcastHashJoin")[1].split("BroadcastExchange")[0]
    assert "Exchange" not in scanned_rows and "Window" not in scanned_rows
