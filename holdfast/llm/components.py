"""Connected components of links between 64-bit nodes, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.tables import saved


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1000003)).first())


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` for every linked node that is not the least of its component.

    ``links`` has long columns ``a`` and ``b``. Large and small stars alternate until nothing changes:
    every node moves to the least node it can see, so the rounds grow with the logarithm of the
    longest chain. Minima are combined before shuffles, and are written so that adaptive execution
    can split the joins at hot nodes.
    """
    links = saved(links.filter("a != b").select("a", "b").distinct())
    state = _state(links)
    while state[0]:
        both = links.union(links.select("b", "a"))
        least = saved(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")))
        large = saved(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = saved(large.groupBy("a").agg(F.min("b").alias("m")))
        joined = large.join(least, "a")
        links = saved(
            joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", "m"))
            .filter("a != b")
            .distinct()
        )
        before, state = state, _state(links)
        if state == before:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
