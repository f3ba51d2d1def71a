"""Small helpers for operators on document tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.session import saved  # noqa: F401

# The key of a row inside an operator: rows with equal ids and equal texts are alike.
KEYS = ("row_id", "row_text")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_text() -> Column:
    """The text of a document; null is empty."""
    return F.coalesce(F.col("text"), F.lit(""))


def row_keys() -> tuple[Column, Column]:
    """The columns of ``KEYS``; null ids are told apart from every id by the second."""
    return (
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("row_id"),
        F.xxhash64(F.col("doc_id").isNull(), plain_text()).alias("row_text"),
    )


def keyed(df: DataFrame) -> DataFrame:
    """Key, id and text only."""
    return df.select(*row_keys(), F.col("doc_id").cast("long").alias("doc_id"), plain_text().alias("text"))


def lower_ascii(text: Column) -> Column:
    """A-Z lowered, nothing else. Pure ASCII texts take the faster way."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, letters, letters.lower())
    )


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` lacks."""
    taken = {c.lower() for c in df.columns}
    return stem if stem.lower() not in taken else f"{stem}_{uuid.uuid4().hex}"


def document_columns(df: DataFrame) -> Sequence[str]:
    return [c for c in ("doc_id", "text", "lang", "source", "n_chars") if c in df.columns]


def whole(df: DataFrame) -> DataFrame:
    """As ``keyed``, with all columns but the text in a struct ``row``, so that no name can clash."""
    others = [F.col(f"`{c}`") for c in df.columns if c.lower() != "text"]
    return df.select(*row_keys(), plain_text().alias("text"), F.struct(*others).alias("row"))


def with_text(rows: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The document columns of ``docs`` from ``row``, with the text from column ``text``."""
    found = {
        "text": F.col(text),
        "n_chars": F.char_length(F.col(text)).cast("long"),
    }
    return rows.select(*(found.get(c, F.col("row").getField(c)).alias(c) for c in document_columns(docs)))
