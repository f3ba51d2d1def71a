"""Parquet tables bucketed by customer.

Tables with the same bucket count join on the customer without a shuffle. The
files can be opened again in another session: the bucket number is part of the
file names.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from holdfast.session import scratch_path

KEY = "customer_id"
ROWS_PER_BUCKET = 4_000_000
# Buckets are kept in this many folders at most, which can be replaced one by one.
MOST_PARTS = 256
PART = "holdfast_part"


def table_name(path: str) -> str:
    return "holdfast_" + hashlib.md5(path.encode()).hexdigest()[:16]


def buckets_for(rows: int, least: int = 8, most: int = 50_000) -> int:
    """A bucket per four million rows (a few hundred MB), ``least`` at least.

    ``most`` is what ``spark.sql.sources.bucketing.maxBuckets`` allows (100,000 unless it is set);
    a table that needs more is refused rather than given ever larger buckets.
    """
    wanted = max(least, -(-rows // ROWS_PER_BUCKET))
    if wanted > most:
        raise ValueError(f"{rows} rows need {wanted} buckets; raise `most` (now {most}) or ROWS_PER_BUCKET")
    return wanted


def write_bucketed(df: DataFrame, path: str, buckets: int, key: str = KEY) -> None:
    """Write one sorted file per bucket."""
    (
        df.repartition(buckets, key)
        .write.mode("overwrite")
        .format("parquet")
        .bucketBy(buckets, key)
        .sortBy(key)
        .option("path", path)
        .saveAsTable(table_name(path))
    )


def _registered_alike(spark: SparkSession, name: str, schema: StructType, buckets: int) -> bool:
    described = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    columns = [(f.name, f.dataType) for f in spark.table(name).schema]
    return described.get("Num Buckets") == str(buckets) and columns == [(f.name, f.dataType) for f in schema]


def read_bucketed(
    spark: SparkSession, path: str, schema: StructType, buckets: int, key: str = KEY
) -> DataFrame:
    name = table_name(path)
    if spark.catalog.tableExists(name) and not _registered_alike(spark, name, schema, buckets):
        spark.sql(f"DROP TABLE {name}")  # the table is external: its files stay
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet "
            f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
    return spark.table(name)


def saved_by_customer(df: DataFrame, buckets: int) -> DataFrame:
    """Write rows below the checkpoint folder, bucketed, and continue from the files.

    Joins with tables of as many buckets stay free of shuffles. The plan knows files and buckets by then, so
    the catalogue does not keep the scratch table; its files stay.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "rows")
    write_bucketed(df, path, buckets)
    kept = read_bucketed(spark, path, df.schema, buckets)
    spark.sql(f"DROP TABLE {table_name(path)}")
    return kept


# Tables whose parts lie in different folders


def part_of(buckets: int, key: str = KEY) -> Column:
    """The part that holds a row's bucket."""
    return F.pmod(F.hash(key), F.lit(buckets)) % min(buckets, MOST_PARTS)


def write_parts(df: DataFrame, path: str, buckets: int, key: str = KEY) -> list[int]:
    """Write one sorted file per bucket, in a folder per part; return the parts that have rows."""
    (
        df.withColumn(PART, part_of(buckets, key))
        .repartition(buckets, key)
        .write.mode("overwrite")
        .format("parquet")
        .partitionBy(PART)
        .bucketBy(buckets, key)
        .sortBy(key)
        .option("path", path)
        .saveAsTable(table_name(path))
    )
    spark = df.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target)
    names = [f.getPath().getName() for f in found]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{PART}="))


def read_parts(
    spark: SparkSession, root: str, layout: dict[str, list[int]], schema: StructType, buckets: int, key: str = KEY,
    only: list[int] | None = None,
) -> DataFrame:
    """The table whose parts lie in the folders of ``layout``, bucketed as it was written; ``only`` some parts if given."""
    name = table_name(json.dumps([root, layout, schema.simpleString(), buckets], sort_keys=True))
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}, {PART} int) USING parquet PARTITIONED BY ({PART}) "
            f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{root}/{name}'"
        )
        places = [
            f"PARTITION ({PART}={part}) LOCATION '{root}/{folder}/{PART}={part}'" for folder, parts in layout.items() for part in parts
        ]
        if places:
            spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {' '.join(places)}")
    table = spark.table(name)
    if only is not None:
        table = table.where(F.col(PART).isin(only))
    return table.select(*schema.names)
