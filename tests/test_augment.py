import pytest
from pyspark.sql import functions as F

from holdfast.functions import labels as L
from holdfast.operators import augment
from tests.helpers import one


@pytest.fixture(scope="module")
def grown(logical):
    return augment.augment_scoring_customers(logical.customers, 400)


def test_target_is_reached(grown, logical):
    assert (grown.existing, grown.inserted, grown.final) == (15, 385, 400)
    rows = grown.customers.collect()
    assert sorted(r["customer_id"] for r in rows) == [f"SYN_{n:05d}" for n in range(1, 386)]
    assert {r["dataset_split"] for r in rows} == {"scoring_batch"} and {r["churn"] for r in rows} == {None}
    assert grown.customers.columns == [c for c in logical.customers.columns if c != "id"]


def test_values_stay_in_bounds(grown, logical):
    batch = logical.customers.where("dataset_split = 'scoring_batch'").collect()
    for row in grown.customers.collect():
        sources = [
            s for s in batch
            if all(
                abs(row[f"total_{p}_minutes"] - s[f"total_{p}_minutes"])
                <= s[f"total_{p}_minutes"] * augment.MINUTE_JITTER[p] + 0.051
                and abs(row[f"total_{p}_calls"] - s[f"total_{p}_calls"]) <= augment.CALL_JITTER[p]
                for p in L.MINUTE_RATES
            )
            and row["state"] == s["state"] and abs(row["account_length"] - s["account_length"]) <= 18
        ]
        assert sources, row
        for part, rate in L.MINUTE_RATES.items():
            assert row[f"total_{part}_charge"] == round(row[f"total_{part}_minutes"] * rate, 2)
            assert row[f"total_{part}_minutes"] == round(row[f"total_{part}_minutes"], 1)
            assert row[f"total_{part}_calls"] >= 0
        assert row["account_length"] >= 1 and 0 <= row["customer_service_calls"] <= 9
        if row["voice_mail_plan"] == "No":
            assert row["number_vmail_messages"] == 0
        else:
            assert 1 <= row["number_vmail_messages"] <= 55


def test_every_source_is_drawn_and_plans_flip(logical):
    made = augment.augment_scoring_customers(logical.customers, 6015).customers
    per_state = made.groupBy("state").count().count()
    batch = logical.customers.where("dataset_split = 'scoring_batch'")
    assert per_state == batch.select("state").distinct().count()
    yes = batch.where("voice_mail_plan = 'Yes'").count() / 15
    share = made.where("voice_mail_plan = 'Yes'").count() / 6000
    expected = yes * 0.96 + (1 - yes) * 0.04
    assert abs(share - expected) < 0.03


def test_seed_decides(logical, grown):
    key = F.bit_xor(F.xxhash64(*grown.customers.columns))

    def digest(df):
        return one(df.repartition(3).agg(key.alias("k")))["k"]

    again = augment.augment_scoring_customers(logical.customers, 400)
    other = augment.augment_scoring_customers(logical.customers, 400, seed=7)
    assert digest(again.customers) == digest(grown.customers) != digest(other.customers)


def test_numbers_continue(logical, grown):
    with_first = logical.customers.unionByName(
        grown.customers.withColumn("id", F.lit(None).cast("int")).select(*logical.customers.columns)
    )
    more = augment.augment_scoring_customers(with_first, 402)
    assert sorted(r["customer_id"] for r in more.customers.collect()) == ["SYN_00386", "SYN_00387"]


def test_inserted_rows_get_the_next_ids(logical, grown):
    whole = augment.insert_synthetic(logical.customers, grown)
    assert whole.columns == logical.customers.columns and whole.count() == 150 + 385
    added = whole.where("customer_id LIKE 'SYN%'").orderBy("customer_id")
    assert [r["id"] for r in added.collect()] == list(range(151, 151 + 385))
    assert whole.where("dataset_split = 'scoring_batch'").count() == 400


def test_large_enough_batch_is_left_alone(logical):
    found = augment.augment_scoring_customers(logical.customers, 15)
    assert (found.inserted, found.final) == (0, 15) and found.customers.isEmpty()


def test_no_sources(logical):
    with pytest.raises(ValueError, match="No scoring_batch"):
        augment.augment_scoring_customers(logical.customers.where("dataset_split = 'train'"), 10)


def test_missing_source_values(spark, logical):
    columns = [c for c in logical.customers.columns if c not in ("id", "customer_id", "dataset_split")]
    empty = logical.customers.limit(1).select(
        F.lit(1).cast("bigint").alias("number"), *[F.lit(None).cast(logical.customers.schema[c].dataType).alias(c) for c in columns]
    )
    row = one(augment.synthetic_customers(empty, 42))
    assert row["total_day_minutes"] == 0.0 and row["account_length"] >= 1
    assert row["voice_mail_plan"] in ("No", "Yes")


@pytest.mark.parametrize(
    "text, flipped, kept",
    [("\tYes", "No", "Yes"), (" no\n", "Yes", "no"), ("1\r\n", "No", "1"), ("", "Yes", "No"), ("\x0bTRUE ", "No", "TRUE")],
)
def test_plan_text_loses_all_white_space(spark, text, flipped, kept):
    row = spark.createDataFrame([(text,)], "plan string")
    found = row.select(
        augment._flip(F.col("plan"), 1.0, F.lit(0.5)).alias("flipped"), augment._flip(F.col("plan"), 0.0, F.lit(0.5)).alias("kept")
    ).first()
    assert (found["flipped"], found["kept"]) == (flipped, kept)
