"""Registered queries, each with the SQL that gives the same result where SQL can."""

from holdfast.queries import (  # noqa: F401
    aggregates,
    customer_pages,
    expressions,
    model_runs,
    ordering,
    quality_checks,
    table_io,
)
from holdfast.queries.registry import ORACLES, QUERIES  # noqa: F401
