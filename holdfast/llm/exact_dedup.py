"""Exact duplicates by naming blocks with integers (operator 7). DataFrame functions only.

Deterministic block naming. The normalised text is cut into blocks of ``BLOCK`` code points. Distinct
blocks are sorted and numbered: equal blocks have one name, different ones have different names. Then
adjacent pairs of names are named in the same way, level by level, until one name is left; it and its
level are the document's identity, and no two different texts share one. Nothing rests on hashes being
free of collisions: a block's hash only tells where it is sorted and stands for it while no other
block has it, which is seen when blocks are named.

The text is shuffled once, after copies within a task are combined; all else moves integers. Each
level halves the names, and documents leave when one is left.

Defined results: null and empty texts are equal; rows with equal id and text are one document, which
``group_size`` counts as often as it occurs and whose rows all stay or go together; null ids are the
least and stay only where no other id is in the group; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.tables import KEYS, keyed, lower_ascii, read_table, saved

BLOCK = 4096


def blocks_of(text: Column, size: int = BLOCK) -> Column:
    found = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % size), F.lit(0))
    return F.when(F.octet_length(text) == 0, F.array(F.lit(""))).otherwise(found)


def named(distinct: DataFrame, *order: str) -> DataFrame:
    """Number sorted distinct rows. Written at once, so that every reader sees the same numbers."""
    return saved(distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id()))


def first_names(texts: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """``row_id``, ``row_text``, ``place``, ``name`` of all blocks. ``docs`` has the hashes of their blocks."""
    blocks = texts.select(*KEYS, F.posexplode(blocks_of(F.col("text"), size)).alias("place", "block"))
    groups = blocks.groupBy(F.xxhash64("block").alias("hash")).agg(F.collect_set("block").alias("same"))
    names = named(groups.select("hash", F.size("same").alias("others"), F.explode("same").alias("block")), "block", "hash")
    places = docs.select(*KEYS, F.posexplode("hashes").alias("place", "hash"))
    alone = places.join(names.filter("others = 1").select("hash", "name"), "hash").select(*KEYS, "place", "name")
    several = names.filter("others > 1").select("hash", "block", "name")
    if several.isEmpty():
        return alone
    return alone.union(
        blocks.withColumn("hash", F.xxhash64("block")).join(several, ["hash", "block"]).select(*KEYS, "place", "name")
    )


def identities(texts: DataFrame, docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """``row_id``, ``row_text``, ``level``, ``name``: one identity per different row key."""
    counts = docs.select(*KEYS, F.size("hashes").alias("blocks")).distinct()
    most = counts.agg(F.max("blocks")).first()[0] or 0
    names = saved(
        first_names(texts, docs, size).distinct().join(counts, list(KEYS)).select(*KEYS, "place", "name", "blocks")
    )
    level, done = 0, []
    while True:
        done.append(names.filter("blocks = 1").select(*KEYS, F.lit(level).alias("level"), "name"))
        if most <= 1:
            break
        left, right = (F.max(F.when(F.col("place") % 2 == k, F.col("name"))) for k in (0, 1))
        pairs = saved(
            names.filter("blocks > 1")
            .groupBy(*KEYS, F.expr("place div 2").cast("int").alias("place"))
            .agg(left.alias("first"), F.coalesce(right, F.lit(-1)).alias("second"), F.max("blocks").alias("blocks"))
        )
        numbers = named(pairs.select("first", "second").distinct(), "first", "second")
        names = saved(
            pairs.join(numbers, ["first", "second"]).select(
                *KEYS, "place", "name", F.ceil(F.col("blocks") / 2).cast("int").alias("blocks")
            )
        )
        level, most = level + 1, (most + 1) // 2
    found = done[0]
    for more in done[1:]:
        found = found.union(more)
    return found


def exact_groups(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, a row per document."""
    texts = keyed(docs).withColumn("text", lower_ascii(F.col("text")))
    rows = saved(
        texts.select(
            *KEYS,
            "doc_id",
            F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
            F.transform(blocks_of(F.col("text"), size), lambda b: F.xxhash64(b)).alias("hashes"),
        )
    )
    named_rows = rows.drop("hashes").join(identities(texts, rows, size), list(KEYS))
    groups = saved(
        named_rows.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    )
    return named_rows.join(groups, ["level", "name"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH texts AS (
    SELECT doc_id, TRANSLATE(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
), groups AS (SELECT text, MAX(doc_id) AS keep_id, COUNT(*) AS group_size FROM texts GROUP BY text)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, SHA256(text) AS text_sha256
FROM texts JOIN groups USING (text)
"""
