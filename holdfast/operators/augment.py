"""Synthetic customers for volume tests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions import draws
from holdfast.functions import labels as L
from holdfast.functions.numbers import exact_round
from holdfast.functions.rules import says_yes, trimmed
from holdfast.operators.numbering import backfill_ids, last_synthetic_number, numbered

DEFAULT_TARGET = 1800
SCORING_SPLIT = "scoring_batch"

# Jitter of each column.
MINUTE_JITTER = {"day": 0.18, "eve": 0.16, "night": 0.16, "intl": 0.22}
CALL_JITTER = {"day": 14, "eve": 14, "night": 14, "intl": 2}
ACCOUNT_JITTER = 18
MESSAGE_JITTER = 4
SERVICE_CALL_JITTER = 1
VOICE_FLIP = 0.04
INTL_FLIP = 0.03

# Order in which the draws of a row are taken from its digests.
DRAW_NAMES = (
    "day", "eve", "night", "intl",
    "voice_flip", "messages", "account", "intl_flip",
    "day_calls", "eve_calls", "night_calls", "intl_calls",
    "service_calls",
)


@dataclass(frozen=True)
class Augmented:
    existing: int
    inserted: int
    final: int
    customers: DataFrame


def _flip(value, probability: float, draw):
    """Plan text, turned into its opposite with the given probability."""
    kept = trimmed(F.when(value != "", value).otherwise("No"))
    return F.when(draw >= probability, kept).otherwise(F.when(says_yes(kept, "none"), "No").otherwise("Yes"))


def synthetic_customers(sources: DataFrame, seed: int) -> DataFrame:
    """Vary source rows; ``number`` names the new customer and seeds its draws."""
    blocks = {
        f"__d{i}": draws.digest(seed, F.col("number"), f"d{i}")
        for i in range((len(DRAW_NAMES) + 3) // draws.DRAWS_PER_DIGEST)
    }
    seeded = sources.withColumns(blocks)

    def draw(name: str):
        block, slot = divmod(DRAW_NAMES.index(name), draws.DRAWS_PER_DIGEST)
        return draws.uniform(F.col(f"__d{block}"), slot)

    def moved(column: str, delta: int, name: str, low: int, missing: int = 0):
        return F.greatest(F.lit(low), draws.step(F.coalesce(column, F.lit(missing)), delta, draw(name)))

    minutes = {}
    for part, ratio in MINUTE_JITTER.items():
        source = F.coalesce(f"total_{part}_minutes", F.lit(0.0))
        varied = F.greatest(F.lit(0.0), draws.spread(source, ratio, draw(part)))
        minutes[f"total_{part}_minutes"] = exact_round(varied, 1)
    staged = seeded.withColumns(
        {
            **minutes,
            "voice_mail_plan": _flip(F.col("voice_mail_plan"), VOICE_FLIP, draw("voice_flip")),
            "international_plan": _flip(F.col("international_plan"), INTL_FLIP, draw("intl_flip")),
        }
    )
    messages = F.least(F.lit(55), moved("number_vmail_messages", MESSAGE_JITTER, "messages", 1))
    has_voice_mail = says_yes(F.col("voice_mail_plan"), "none")
    return staged.withColumns(
        {
            "customer_id": F.format_string("SYN_%05d", F.col("number")),
            "dataset_split": F.lit(SCORING_SPLIT),
            "account_length": moved("account_length", ACCOUNT_JITTER, "account", 1, missing=1),
            "number_vmail_messages": F.when(has_voice_mail, messages).otherwise(0),
            **{
                f"total_{part}_calls": moved(f"total_{part}_calls", delta, f"{part}_calls", 0)
                for part, delta in CALL_JITTER.items()
            },
            **{
                f"total_{part}_charge": exact_round(F.col(f"total_{part}_minutes") * rate, 2)
                for part, rate in L.MINUTE_RATES.items()
            },
            "customer_service_calls": F.least(
                F.lit(9), moved("customer_service_calls", SERVICE_CALL_JITTER, "service_calls", 0)
            ),
            "churn": F.lit(None).cast("int"),
        }
    ).drop("number", *blocks)


def augment_scoring_customers(
    customers: DataFrame, target: int = DEFAULT_TARGET, seed: int = 42
) -> Augmented:
    """Fill the scoring batch up to ``target`` customers.

    New customers are varied copies of existing ones, chosen with replacement by
    a uniform draw: the join on the chosen position has no hot key.
    """
    columns = [c for c in customers.columns if c != "id"]
    batch = customers.where(F.col("dataset_split") == SCORING_SPLIT)
    existing = batch.count()
    if existing >= target:
        return Augmented(existing, 0, existing, customers.limit(0).select(*columns))
    if existing == 0:
        raise ValueError("No scoring_batch customers found to augment.")
    missing = target - existing
    next_number = last_synthetic_number(customers).first()[0] + 1
    sources = numbered(batch.select("id", *columns), ["id"], "position", start=0)
    wanted = customers.sparkSession.range(next_number, next_number + missing).select(
        F.col("id").alias("number"), draws.pick(seed, F.col("id"), existing).alias("position")
    )
    drawn = wanted.join(sources, "position").drop("position", "id")
    made = synthetic_customers(drawn, seed).select(*columns)
    return Augmented(existing, missing, target, made)


def insert_synthetic(customers: DataFrame, made: Augmented) -> DataFrame:
    """The customer table with the new rows, whose ids continue after the largest one."""
    added = customers.unionByName(made.customers, allowMissingColumns=True)
    return backfill_ids(added, ["customer_id"]).select(*customers.columns)
