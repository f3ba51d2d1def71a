"""Registry of queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.queries.base_sql import BASE
from holdfast.queries.tables import Tables, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: str = ""):
    """Register a function of ``Tables``. ``ctes`` are added to the shared SQL tables."""

    def register(function: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(tables(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = BASE + (",\n" + ctes if ctes else "") + "\n" + sql
        return function

    return register


def six(column: str | Column) -> Column:
    """Six decimals: sums of doubles depend on the order of addition."""
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value, 6)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: six(c) for c in columns})


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_case(column: str, entries: dict[str, str], otherwise: str | None = None) -> str:
    """A CASE over the entries of a dictionary; unknown values stay unless told otherwise."""
    whens = " ".join(f"WHEN {sql_text(k)} THEN {sql_text(v)}" for k, v in entries.items())
    return f"CASE {column} {whens} ELSE {otherwise or column} END"
