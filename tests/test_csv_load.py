"""Lines that do not fit the schema are set aside."""

import os

import pytest

from holdfast.session import scratch_path
from holdfast.sources import csv

SCHEMA = "id BIGINT, name STRING, amount DOUBLE, made TIMESTAMP"


def loaded(spark, *files, **options):
    from pyspark.sql.types import StructType

    folder = scratch_path(spark, "lines").removeprefix("file:")
    os.makedirs(folder)
    for number, text in enumerate(files):
        with open(f"{folder}/{number}.csv", "w", encoding="utf-8") as out:
            out.write(text)
    return csv.load_csv(spark, folder, StructType.fromDDL(SCHEMA), **options)


HEADER = "id,name,amount,made\n"


def test_reasons(spark):
    found = loaded(
        spark,
        HEADER + '1,"a, ""b""",1.5,2024-05-06 07:08:09\n2,b,1.5,2024-05-06 00:00:00,more\n3,c\n',
        HEADER + "x,d,much,2024-05-06 00:00:00\n\n5,,,\n6,f,2,2024-05-06 00:00:00\n",
    )
    assert sorted(r["id"] for r in found.rows.collect()) == [1, 5, 6]
    rejects = {r["line"].split(",")[0]: (r["fields"], r["reason"], r["columns"]) for r in found.rejects.collect()}
    assert rejects == {
        "2": (5, "too many fields", []),
        "3": (2, "too few fields", []),
        "x": (4, "not of the column's type", ["id", "amount"]),
    }
    assert (found.accepted, found.rejected) == (3, 3)


def test_few_columns_asked_for(spark):
    """A bad value is found although its column is not read later."""
    found = loaded(spark, HEADER + "1,a,none,2024-05-06 00:00:00\n2,b,1,2024-05-06 00:00:00\n")
    assert [r["id"] for r in found.rows.select("id").collect()] == [2]


def test_separators_inside_quotes_are_no_fields(spark):
    found = loaded(spark, HEADER + '1,"a,b,c",bad,2024-05-06 00:00:00\n')
    assert [(r["fields"], r["columns"]) for r in found.rejects.collect()] == [(4, ["amount"])]


def test_limit_of_rejects(spark):
    text = HEADER + "1,a,1,2024-05-06 00:00:00\n2\n"
    assert loaded(spark, text, most_rejected=1).rejected == 1
    with pytest.raises(csv.RejectedLines, match="1 of 2 lines"):
        loaded(spark, text, most_rejected=0)


def test_clean_and_empty_files(spark):
    clean = loaded(spark, HEADER + "1,a,1,2024-05-06 00:00:00\n", most_rejected=0)
    assert (clean.accepted, clean.rejected, clean.rejects.count()) == (1, 0, 0)
    nothing = loaded(spark, HEADER, most_rejected=0)
    assert (nothing.accepted, nothing.rejected, nothing.rows.count()) == (0, 0, 0)


def test_header_in_another_order_fails(spark):
    with pytest.raises(Exception, match="(?i)header"):
        loaded(spark, "name,id,amount,made\na,1,1,2024-05-06 00:00:00\n")
