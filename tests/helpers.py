"""Small result tables built by hand."""

from datetime import datetime

from holdfast import schemas

DATE = datetime(2024, 5, 6, 7, 8, 9)


def prediction(customer, probability=0.5, group="Medium", factor="High day charge", charge=50.0, date=DATE):
    return (customer, 1, probability, group, factor, charge, date)


def predictions(spark, rows):
    return spark.createDataFrame(rows, schemas.PREDICTIONS)


def segments(spark, rows):
    return spark.createDataFrame(rows, schemas.SEGMENTS)


def recommendations(spark, rows):
    return spark.createDataFrame(rows, schemas.RECOMMENDATIONS)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def evaluate(spark, expression, **values):
    """The value of a column expression over one row of named values."""
    from pyspark.sql import functions as F

    row = spark.range(1).withColumns({k: v if hasattr(v, "cast") else F.lit(v) for k, v in values.items()})
    return one(row.select(expression.alias("x")))["x"]
