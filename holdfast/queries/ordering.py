"""Splits, consecutive numbers and ordered scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdfast import schemas
from holdfast.operators import features, numbering
from holdfast.queries.registry import query
from holdfast.queries.tables import Tables
from holdfast.sources.customers import customers_in_splits

COLUMNS = ", ".join(schemas.CUSTOMERS.names)


@query("s04_split_scan", f"SELECT {COLUMNS} FROM raw WHERE dataset_split IN ('test', 'scoring_batch')")
def s04(t: Tables):
    return customers_in_splits(t.customers, ["test", "scoring_batch"])


@query("a20_split_counts", "SELECT dataset_split, count(*) AS customers_count FROM raw GROUP BY 1")
def a20(t: Tables):
    return numbering.split_counts(t.customers)


@query("w05_ordered_split", "SELECT id, dataset_split FROM raw")
def w05(t: Tables):
    return numbering.ordered_split(t.customers.select("id"))


@query(
    "w05_existing_split_kept",
    """SELECT id, CASE WHEN voice_mail_plan = 'Yes' THEN 'kept' ELSE dataset_split END AS dataset_split FROM raw""",
)
def w05_kept(t: Tables):
    kept = F.when(F.col("voice_mail_plan") == "Yes", "kept")
    return numbering.ordered_split(t.customers.select("id", kept.alias("dataset_split")))


@query(
    "w06_id_backfill",
    """SELECT customer_id, CAST(CASE WHEN voice_mail_plan <> 'Yes' THEN id
    ELSE max(CASE WHEN voice_mail_plan <> 'Yes' THEN id END) OVER ()
      + row_number() OVER (PARTITION BY voice_mail_plan ORDER BY customer_id) END AS BIGINT) AS id FROM raw""",
)
def w06(t: Tables):
    gaps = t.customers.select("customer_id", F.when(F.col("voice_mail_plan") != "Yes", F.col("id")).alias("id"))
    return numbering.backfill_ids(gaps, ["customer_id"])


@query(
    "f03_customer_ids",
    """SELECT id, 'C' || CASE WHEN n < 100000 THEN lpad(CAST(n AS VARCHAR), 5, '0')
    ELSE CAST(n AS VARCHAR) END AS customer_id
  FROM (SELECT id, row_number() OVER (ORDER BY id DESC) AS n FROM raw) numbered_rows""",
)
def f03(t: Tables):
    bare = t.customers.select("id").withColumn("falling", -F.col("id"))
    return features.add_customer_ids(bare, ["falling"]).select("id", "customer_id")


def in_files(t: Tables, name: str, df):
    """The rows in eight files that follow each other in the order of ``key``."""
    path = t.scratch(name)
    df.repartitionByRange(8, "key").sortWithinPartitions("key").write.parquet(path)
    return t.spark.read.schema(df.schema).parquet(path)


@query(
    "w06_backfill_as_stored",
    """SELECT id AS key, CAST(CASE WHEN voice_mail_plan <> 'Yes' THEN id
    ELSE max(CASE WHEN voice_mail_plan <> 'Yes' THEN id END) OVER ()
      + row_number() OVER (PARTITION BY voice_mail_plan ORDER BY id DESC) END AS BIGINT) AS id FROM raw""",
)
def w06_as_stored(t: Tables):
    """Files hold the customers in falling order; those without an id are numbered where they lie."""
    gap = F.when(F.col("voice_mail_plan") != "Yes", F.col("id"))
    stored = in_files(t, "gaps", t.customers.select((-F.col("id")).alias("key"), gap.alias("id")))
    filled = numbering.backfill_ids(stored, numbering.AS_STORED)
    return filled.select((-F.col("key")).alias("key"), "id")


@query(
    "f03_ids_as_stored",
    """SELECT id, 'C' || CASE WHEN n < 100000 THEN lpad(CAST(n AS VARCHAR), 5, '0')
    ELSE CAST(n AS VARCHAR) END AS customer_id
  FROM (SELECT id, row_number() OVER (ORDER BY id DESC) AS n FROM raw) numbered_rows""",
)
def f03_as_stored(t: Tables):
    """Every row of the files is numbered: no row is moved or written."""
    stored = in_files(t, "bare", t.customers.select((-F.col("id")).alias("key")))
    return features.add_customer_ids(stored, numbering.AS_STORED).select((-F.col("key")).alias("id"), "customer_id")


@query(
    "f04_customer_id_backfill",
    """SELECT id, CASE WHEN voice_mail_plan = 'Yes' THEN customer_id
    ELSE 'C' || lpad(CAST(id * 100 AS VARCHAR), 5, '0') END AS truncated,
  CASE WHEN voice_mail_plan = 'Yes' THEN customer_id ELSE 'C' || CASE WHEN id * 100 < 100000
    THEN lpad(CAST(id * 100 AS VARCHAR), 5, '0') ELSE CAST(id * 100 AS VARCHAR) END END AS whole FROM raw""",
)
def f04(t: Tables):
    """Ids times 100, so that some have six digits and the two forms differ."""
    kept = F.when(F.col("voice_mail_plan") == "Yes", F.col("customer_id"))
    gaps = t.customers.select(
        F.col("id").alias("key"), (F.col("id") * 100).alias("id"), kept.alias("customer_id"),
        kept.alias("stored"),
    )
    cut = features.backfill_customer_ids(gaps, truncate=True).withColumnsRenamed(
        {"customer_id": "truncated", "stored": "customer_id"}
    )
    whole = features.backfill_customer_ids(cut)
    return whole.select(F.col("key").alias("id"), "truncated", F.col("customer_id").alias("whole"))


@query(
    "a19_last_synthetic_number",
    """SELECT max(id) AS last_number FROM (SELECT CAST(id AS BIGINT) AS id FROM raw
  WHERE dataset_split = 'scoring_batch') batch""",
)
def a19(t: Tables):
    named = F.when(F.col("dataset_split") == "scoring_batch", F.format_string("SYN_%05d", F.col("id")))
    return numbering.last_synthetic_number(
        t.customers.select(F.coalesce(named, F.col("customer_id")).alias("customer_id"))
    )
