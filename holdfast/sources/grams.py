"""An index of the texts inside customer ids, which tells the parts of a result table that a search can match.

A *gram* is what an id, in lower case, has from any of its places on, ``GRAM`` characters at most. Per gram
there is a bitmap of the parts that hold it. A text of up to ``GRAM`` characters occurs in an id just where a
gram starts with it, so its parts are exact; of a longer one all grams have to occur. Grams are sorted, so a
search reads the row groups of its own range.

The index only leaves out parts; the search itself is checked on the rows that are read. It has a row per
distinct gram, combined before the shuffle: about as many as ids, times the places of an id.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.operators.filters import like_pattern
from holdfast.sources.buckets import KEY, MOST_PARTS, part_of
from holdfast.sources.files import exists

GRAM = 8
# Grams of one search that are looked up; further ones would only leave out more.
MOST_GRAMS = 16
_WORD = 64
WORDS = MOST_PARTS // _WORD
SCHEMA = "gram string, " + ", ".join(f"parts_{k} long" for k in range(WORDS))


def literal_runs(text: str) -> list[str]:
    """The texts between the wildcards of a search, each of which a matching id must have."""
    tokens = re.findall(r"\\(.)|([%_])|(.)", like_pattern(text), flags=re.DOTALL)
    run = "".join("\0" if wild else (escaped or plain) for escaped, wild, plain in tokens)
    return [r for r in run.split("\0") if r]


def wanted_grams(text: str) -> list[str]:
    """Grams, or beginnings of grams, that all ids found by a search have; longest first."""
    found = {r[i : i + GRAM] for r in literal_runs(text) for i in range(max(1, len(r) - GRAM + 1))}
    return sorted(found, key=lambda g: (-len(g), g))[:MOST_GRAMS]


def grams(df: DataFrame, buckets: int) -> DataFrame:
    """``gram`` and its bitmap ``parts_0`` .. of the parts of a table with so many buckets."""
    text = F.lower(KEY)
    places = F.sequence(F.lit(1), F.char_length(text))
    own = F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(GRAM))))
    found = df.where(F.char_length(KEY) > 0).select(part_of(buckets).alias("part"), F.explode(own).alias("gram"))
    bit = F.expr(f"shiftleft(1L, part % {_WORD})")
    words = [F.when(F.floor(F.col("part") / _WORD) == k, bit).otherwise(F.lit(0)) for k in range(WORDS)]
    return found.groupBy("gram").agg(*(F.bit_or(w.cast("bigint")).alias(f"parts_{k}") for k, w in enumerate(words)))


def write_grams(df: DataFrame, path: str, buckets: int) -> None:
    grams(df, buckets).orderBy("gram").write.mode("overwrite").parquet(path)


def parts_with(spark: SparkSession, path: str, text: str) -> set[int] | None:
    """Parts that hold every wanted gram of a search; ``None`` if nothing can be told."""
    wanted = wanted_grams(text)
    if not wanted or not exists(spark, path):
        return None
    starts = [F.col("gram").startswith(w) for w in wanted]
    index = spark.read.schema(SCHEMA).parquet(path).where(reduce(or_, starts))
    # One row, of a fixed number of columns at most.
    row = index.agg(
        *(F.bit_or(F.when(s, F.col(f"parts_{k}"))).alias(f"g{i}_{k}") for i, s in enumerate(starts) for k in range(WORDS))
    ).first()
    held = range(MOST_PARTS)
    for i in range(len(wanted)):
        held = [p for p in held if (row[f"g{i}_{p // _WORD}"] or 0) >> (p % _WORD) & 1]
    return set(held)
