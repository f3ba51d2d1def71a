"""Cleaning of a document table in stages: ``run(spark, sf_dir)`` applies ``STAGES`` in turn.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet below
the checkpoint folder and read again as the next stage's documents. All but the last return the columns
of documents: language ID rejects texts in no known language, line dedup takes common lines out,
SimHash leaves one document of each component of close fingerprints, decontamination drops documents
with a benchmark item, and packing returns the pieces of the training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from holdfast.llm import decontaminate, language_id, line_dedup, packing, simhash
from holdfast.llm.tables import read_table, saved


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_common_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.without_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# No SQL counterpart: no stage but line dedup can be said in SQL; see tests/llm for brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
