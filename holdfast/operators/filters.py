"""Customer filters and the checks on filter arguments."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions import labels as L


@dataclass(frozen=True)
class CustomerFilter:
    """Optional conditions, all of which must hold. ``All`` and empty text mean no condition."""

    search: str | None = None
    risk_group: str | None = None
    segment: str | None = None
    recommendation: str | None = None
    min_probability: float | None = None
    main_risk_factor: str | None = None

    def __post_init__(self):
        if self.min_probability is not None and not 0 <= self.min_probability <= 1:
            raise ValueError("min_probability must be between 0 and 1")

    def equalities(self) -> dict[str, str]:
        """Column and wanted value of each equality condition that is on."""
        wanted = {
            "risk_group": self.risk_group,
            "segment_name": self.segment,
            "recommendation_type": self.recommendation,
            "main_risk_factor": self.main_risk_factor,
        }
        return {name: value for name, value in wanted.items() if value and value != "All"}

    def conditions(self) -> list[Column]:
        found = [F.col(name) == value for name, value in self.equalities().items()]
        if self.search:
            found.append(id_contains(self.search))
        if self.min_probability is not None:
            found.append(F.col("churn_probability") >= self.min_probability)
        return found

    def apply(self, df: DataFrame) -> DataFrame:
        for condition in self.conditions():
            df = df.where(condition)
        return df

    def needs_segments(self) -> bool:
        return "segment_name" in self.equalities()

    def needs_recommendations(self) -> bool:
        return "recommendation_type" in self.equalities()

    def selects_something(self) -> bool:
        """Whether an export may run: blank search text and a zero probability do not count."""
        return bool(
            self.equalities()
            or (self.search and self.search.strip())
            or (self.min_probability and self.min_probability > 0)
        )


def like_pattern(text: str) -> str:
    """Pattern of a search text. A backslash takes ``%``, ``_`` and itself literally; before others it goes."""
    return re.sub(r"\\(?![%_\\])|(\\.)", r"\1", f"%{text}%".lower(), flags=re.DOTALL)


def id_contains(text: str) -> Column:
    """Case-insensitive search in the id; ``%`` and ``_`` act as wildcards."""
    return F.lower("customer_id").like(like_pattern(text))


# Fixed value: most rows of a page.
PAGE_LIMIT = 500


def check_page(limit: int, offset: int) -> None:
    if not 1 <= limit <= PAGE_LIMIT:
        raise ValueError(f"limit must be between 1 and {PAGE_LIMIT}")
    if offset < 0:
        raise ValueError("offset must not be negative")


def check_export(chosen: CustomerFilter, fields: list[str] | None) -> None:
    if not chosen.selects_something():
        raise ValueError("At least one customer export filter is required")
    if any(name not in L.EXPORT_HEADERS for name in fields or ()):
        raise ValueError("Unknown customer export fields")


def active_only(df: DataFrame) -> DataFrame:
    """Rows with a recommendation other than no action (NULL is dropped too)."""
    return df.where(F.col("recommendation_type") != L.NO_ACTION)
