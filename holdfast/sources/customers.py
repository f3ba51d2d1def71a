"""Reading the customer table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast import schemas
from holdfast.operators.features import nan_to_null


def customers_in_splits(customers: DataFrame, splits: list[str], ordered: bool = True) -> DataFrame:
    """The scoring columns of the customers in the given splits.

    Training and scoring do not depend on row order: pass ``ordered=False`` there
    and save the sort.
    """
    rows = nan_to_null(
        customers.where(F.col("dataset_split").isin(*splits)).select(*schemas.CUSTOMERS.names)
    )
    return rows.orderBy("id") if ordered else rows
