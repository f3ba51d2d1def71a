"""Feature preparation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions import rules
from holdfast.operators.numbering import numbered

CHARGES = tuple(f"total_{part}_charge" for part in ("day", "eve", "night", "intl"))


def optional(df: DataFrame, name: str, kind: str) -> Column:
    """The column, or NULL where the table has none of that name."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers as NULL. Spark sorts NaN above every number, so it must not reach a rule."""
    floats = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.select(
        *[
            F.when(~F.isnan(name), F.col(name)).alias(name) if name in floats else F.col(name)
            for name in df.columns
        ]
    )


def normalize_plans(df: DataFrame) -> DataFrame:
    """Plan columns as yes/no text; columns the table lacks stay absent."""
    present = [c for c in ("international_plan", "voice_mail_plan") if c in df.columns]
    return df.withColumns({c: rules.yes_no_text(F.col(c)) for c in present})


def add_estimated_total_charge(df: DataFrame) -> DataFrame:
    """Add the sum of the four charges; absent charge columns are added as 0."""
    absent = {c: F.lit(0.0) for c in CHARGES if c not in df.columns}
    filled = df.withColumns(absent) if absent else df
    return filled.withColumn("estimated_total_charge", rules.total_charge(*[F.col(c) for c in CHARGES]))


def add_customer_ids(df: DataFrame, order_by: list[str] | str | None = None) -> DataFrame:
    """Number the rows C00001, C00002, ... in the given order, ``AS_STORED``, or as they come, if they have no ids."""
    if "customer_id" in df.columns:
        return df
    ranked = numbered(df, order_by, "__number")
    return ranked.withColumn("customer_id", F.format_string("C%05d", F.col("__number"))).drop("__number")


def backfill_customer_ids(df: DataFrame, truncate: bool = False) -> DataFrame:
    """Fill missing customer ids from ``id``.

    ``truncate`` cuts ids of six and more digits to five, as the SQL backfill
    does; the default keeps every digit, so ids stay unique.
    """
    text = F.col("id").cast("string")
    padded = F.lpad(text, 5, "0")
    shown = padded if truncate else F.when(F.length(text) < 5, padded).otherwise(text)
    return df.withColumn("customer_id", F.coalesce("customer_id", F.concat(F.lit("C"), shown)))


def prepare_features(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """Customer ids, plan text and the estimated total charge."""
    return add_estimated_total_charge(normalize_plans(add_customer_ids(df, order_by)))
