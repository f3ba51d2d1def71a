"""Ranks, splits and consecutive numbers without a global window.

A window over the whole table would move every row into one task. Split limits
are found from counts per key range instead, and consecutive numbers from row
counts per partition.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.session import saved

SPLIT_NAMES = ("train", "validation", "test", "scoring_batch")
SPLIT_PERCENTS = (60, 75, 90)
_STEP = 16

# As ``order_by``: rows of a Parquet folder by the names of its files and their places in them.
AS_STORED = "as stored"
BLOCK_ROWS = 1 << 20


def keys_at_ranks(df: DataFrame, key: str, ranks: list[int]) -> dict[int, int]:
    """The key at each 1-based rank in ascending key order, for whole-number keys.

    Narrows the key range 16 bits at a time. Each pass counts the rows per range
    (at most 65,536 ranges for each rank looked for) and keeps the range each
    rank lies in, so a 32-bit key takes two passes over one column and a 64-bit
    key four. What reaches the driver is one row per rank.
    """
    wanted = sorted({rank for rank in ranks if rank > 0})
    bits = 64 if dict(df.dtypes)[key] == "bigint" else 32
    keys = df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("k"))
    place = {rank: (None, rank) for rank in wanted}
    for shift in range(bits - _STEP, -1, -_STEP):
        scope = keys
        ranges = {prefix for prefix, _ in place.values() if prefix is not None}
        if ranges:
            width = 1 << (shift + _STEP)
            inside = [F.col("k").between(p * width, (p + 1) * width - 1) for p in ranges]
            scope = keys.where(reduce(or_, inside))
        counted = scope.groupBy(F.shiftright("k", shift).alias("prefix")).agg(F.count("*").alias("n"))
        within = F.shiftright("prefix", _STEP)
        if not ranges:
            within = F.lit(0)
        running = Window.partitionBy("parent").orderBy("prefix")
        placed = counted.withColumn("parent", within.cast("bigint")).withColumn(
            "upto", F.sum("n").over(running)
        )
        hits = []
        for parent, rest in place.values():
            hit = (F.col("upto") >= rest) & (F.col("upto") - F.col("n") < rest)
            hits.append(hit if parent is None else hit & (F.col("parent") == parent))
        found = placed.where(reduce(or_, hits)).collect() if hits else []
        narrowed = {}
        for rank, (parent, rest) in place.items():
            for row in found:
                same = parent is None or row["parent"] == parent
                if same and row["upto"] - row["n"] < rest <= row["upto"]:
                    narrowed[rank] = (row["prefix"], rest - (row["upto"] - row["n"]))
        place = narrowed
    return {rank: prefix for rank, (prefix, _) in place.items()}


def ordered_split(df: DataFrame, key: str = "id", column: str = "dataset_split") -> DataFrame:
    """Give rows without a split one by their rank in ``key``: 60/15/15/10 percent.

    Ranks count all rows, also those that already have a split. Assigning is a
    comparison with three limits, so the rows themselves are not moved.
    """
    total = df.count()
    ranks = [total * percent // 100 for percent in SPLIT_PERCENTS]
    limits = keys_at_ranks(df, key, ranks)
    chain = F.lit(SPLIT_NAMES[-1])
    for name, rank in reversed(list(zip(SPLIT_NAMES, ranks))):
        if rank in limits:
            chain = F.when(F.col(key) <= limits[rank], name).otherwise(chain)
        elif rank > 0:
            # The limit lies among rows without a key, which come last: all keyed rows are below it.
            chain = F.when(F.col(key).isNotNull(), name).otherwise(chain)
    existing = F.col(column) if column in df.columns else F.lit(None).cast("string")
    return df.withColumn(column, F.coalesce(existing, chain))


def numbered(
    df: DataFrame, order_by: list[str | Column] | str | None, column: str, start: int = 1
) -> DataFrame:
    """Number the rows consecutively in the given order, ``AS_STORED``, or as they come.

    But for ``AS_STORED``, the rows are written with the partition they were in and their position there;
    a row's number is its position plus the count of rows in earlier partitions.
    Because both are read back from the files, a task that is run again cannot
    change a number. The broadcast side has one row per partition.
    """
    if order_by == AS_STORED:
        return numbered_as_stored(df, column, start)
    position = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = df.orderBy(*order_by) if order_by else df
    placed = saved(ordered.withColumns({"__part": F.spark_partition_id(), "__position": position}))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__size"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "__part", F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__offset")
    )
    return (
        placed.join(F.broadcast(offsets), "__part")
        .withColumn(column, F.col("__offset") + F.col("__position") + start)
        .select(*df.columns, column)
    )


def numbered_as_stored(df: DataFrame, column: str, start: int = 1, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Number the rows of a Parquet folder by file name and place in the file; nothing is written.

    ``df`` reads one folder and may be filtered and projected, but not joined. Files do not change, so a task that
    is run again gives the same numbers. Rows are counted per block of a file, over columns that are no data;
    a number is the count of rows in earlier blocks plus the place in the block. Where filters left gaps,
    places are counted within each block, the only case in which rows are moved, by block. The global window
    sees one row per block.
    """
    placed = df.select(
        "*",
        F.col("_metadata.file_path").alias("__file"),
        F.floor(F.col("_metadata.row_index") / block_rows).alias("__block"),
        F.col("_metadata.row_index").alias("__row"),
    )
    block = ["__file", "__block"]
    blocks = placed.groupBy(*block).agg(F.count("*").alias("__size"), F.min("__row").alias("__first"), F.max("__row").alias("__last"))
    gaps = not blocks.where(F.col("__last") - F.col("__first") + 1 != F.col("__size")).isEmpty()
    earlier = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(*block, "__first", F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__offset"))
    place = F.col("__row") - F.col("__first")
    if gaps:
        within = Window.partitionBy(*block).orderBy("__row")
        placed = placed.withColumn("__place", F.row_number().over(within).cast("bigint") - 1)
        place = F.col("__place")
    return placed.join(offsets, block).select(*df.columns, (F.col("__offset") + place + start).alias(column))


def backfill_ids(
    df: DataFrame, order_by: list[str] | str | None = None, start: int | None = None
) -> DataFrame:
    """Give rows without an id consecutive ids in the given order, ``AS_STORED``, or as they come.

    Numbering continues after the largest id, so new ids never collide;
    ``start=1`` restarts it, as a first backfill of an empty column does.
    """
    if start is None:
        start = (df.agg(F.max("id")).first()[0] or 0) + 1
    missing = df.where(F.col("id").isNull()).drop("id")
    kind = dict(df.dtypes)["id"]
    filled = numbered(missing, order_by, "id", start).withColumn("id", F.col("id").cast(kind))
    return df.where(F.col("id").isNotNull()).unionByName(filled)


def last_synthetic_number(df: DataFrame) -> DataFrame:
    """The largest number in ids of the form SYN_00001, 0 if there is none."""
    suffix = F.substring("customer_id", 5, 20).cast("bigint")
    return df.where(F.col("customer_id").like("SYN\\_%")).agg(
        F.coalesce(F.max(suffix), F.lit(0)).alias("last_number")
    )


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("dataset_split").agg(F.count("*").alias("customers_count"))
