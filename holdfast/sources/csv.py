"""CSV input and output."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType

from holdfast.session import scratch_path

BOM = "\ufeff"


class RejectedLines(ValueError):
    """More lines than allowed do not fit the schema."""


@dataclass(frozen=True)
class Loaded:
    """Rows that fit the schema, the lines that do not, and how many there are of each."""

    rows: DataFrame
    rejects: DataFrame
    accepted: int
    rejected: int


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Read CSV with a header. Types are inferred unless a schema is given.

    Inference reads the files once more; give the schema for large inputs.
    """
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(path)


def load_csv(
    spark: SparkSession, path: str, schema: StructType, most_rejected: int | None = None, header: bool = True
) -> Loaded:
    """Read CSV whose lines must fit the schema; those that do not are set aside, none is filled with NULLs.

    One scan parses every line whole, whatever columns are asked for later, and writes rows and rejected lines
    side by side below the checkpoint folder; counts come from the written files. A header must name the
    columns in order, or reading fails. More than ``most_rejected`` rejects raise ``RejectedLines``
    (0: a single bad line fails the load). ``rejects`` has the ``line``, its number of ``fields``, the
    ``reason`` and the ``columns`` whose text is not of their type. Empty lines are no rows.
    """
    line = "__line"
    scan = (
        spark.read.schema(T.StructType([*schema.fields, T.StructField(line, T.StringType())]))
        .option("header", header)
        .option("enforceSchema", False)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", line)
        .option("columnPruning", False)
        .csv(path)
    )
    placed = scan.withColumn("__rejected", F.col(line).isNotNull())
    folder = scratch_path(spark, "loaded")
    placed.write.partitionBy("__rejected").parquet(folder)
    written = spark.read.schema(placed.schema).parquet(folder)
    counts = {row["__rejected"]: row["count"] for row in written.groupBy("__rejected").count().collect()}
    accepted, rejected = counts.get(False, 0), counts.get(True, 0)
    if most_rejected is not None and rejected > most_rejected:
        raise RejectedLines(f"{rejected} of {accepted + rejected} lines in {path} do not fit the schema")
    rows = written.where(~F.col("__rejected")).select(*schema.names)
    rejects = explained(written.where("__rejected").select(F.col(line).alias("line")), schema)
    return Loaded(rows, rejects, accepted, rejected)


def explained(lines: DataFrame, schema: StructType) -> DataFrame:
    """Why a ``line`` does not fit the schema."""
    unquoted = F.regexp_replace("line", r'"(?:[^"\\]|\\.)*"', "")
    fields = F.size(F.split(unquoted, ","))
    texts = ", ".join(f"`c{place}` STRING" for place in range(len(schema)))

    def misfit(place: int, field: T.StructField) -> Column:
        text = F.col(f"__texts.c{place}")
        return F.when(text.isNotNull() & text.try_cast(field.dataType).isNull(), F.lit(field.name))

    typed = [misfit(k, field) for k, field in enumerate(schema) if field.dataType != T.StringType()]
    misfits = F.array_compact(F.array(*typed, F.lit(None).cast("string")))
    whole = F.col("fields") == len(schema)
    reason = (
        F.when(F.col("fields") > len(schema), "too many fields")
        .when(F.col("fields") < len(schema), "too few fields")
        .when(F.size("columns") > 0, "not of the column's type")
        .otherwise("unreadable")
    )
    parsed = lines.select("line", fields.alias("fields"), F.from_csv("line", texts).alias("__texts"))
    named = parsed.select("line", "fields", F.when(whole, misfits).otherwise(F.array().cast("array<string>")).alias("columns"))
    return named.select("line", "fields", reason.alias("reason"), "columns")


def normalize_columns(df: DataFrame) -> DataFrame:
    """Column names without outer blanks, in lower case, with _ for blanks and hyphens."""
    marks = str.maketrans(" -", "__")
    return df.toDF(*[name.strip().translate(marks).lower() for name in df.columns])


def append_landing(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_report_csv(df: DataFrame, path: str, keep_empty: bool, single_file: bool = False) -> None:
    """Semicolon-separated CSV with CRLF and a byte order mark, headers as column names.

    ``keep_empty`` decides what an empty result gives: a file with the header
    (customer exports) or nothing at all (summaries). Large exports stay in
    several files, each with its header and in row order; ``single_file`` is for
    results known to be small. A line feed inside a value is written as CRLF too.
    """
    if keep_empty:
        _write_rows(df, path, single_file)
        return
    kept = df.cache()  # summaries: a few rows, looked at before they are written
    try:
        if not kept.isEmpty():
            _write_rows(kept, path, single_file)
    finally:
        kept.unpersist()


def _write_rows(df: DataFrame, path: str, single_file: bool) -> None:
    if single_file:
        df = df.coalesce(1)
    first, *rest = df.columns
    (
        df.toDF(BOM + first, *rest)
        .write.mode("overwrite")
        .option("header", True)
        .option("sep", ";")
        .option("lineSep", "\r\n")
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("nullValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
