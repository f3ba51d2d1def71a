"""Result tables and the scoring job log.

A run writes its three tables to folders of its own and appends a success row,
which names the folders, to the job log last. Readers take the folders of the
latest success, so they see either the old results or all of the new ones, and a
run that fails half-way changes nothing for them.

Any number of runs may write at once: log entries are numbered and made exclusively
(see ``log``), so ids differ and every run has folders of its own; the last to finish
is the one that is read. Keys are checked before a run is shown: NULL or repeated
customers, and segments or recommendations without a prediction, refuse it.

A table is kept in parts of whole buckets. An amendment writes the parts in which a
row differs; its success row takes the others from where they are. Beside the predictions
of a folder lies an index of the texts in its ids (``grams``), for searches.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timezone
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast import schemas
from holdfast.functions import labels as L
from holdfast.operators import quality
from holdfast.sources.buckets import KEY, buckets_for, part_of, read_parts, table_name, write_parts
from holdfast.sources.files import exists
from holdfast.sources.grams import parts_with, write_grams
from holdfast.sources.log import Log

TABLES = {
    "predictions": schemas.PREDICTIONS,
    "customer_segments": schemas.SEGMENTS,
    "customer_recommendations": schemas.RECOMMENDATIONS,
}
LOG_SCHEMA = T.StructType(
    [
        *schemas.SCORING_JOBS.fields,
        T.StructField("revision", T.LongType()),
        T.StructField("buckets", T.IntegerType()),
        T.StructField("folder", T.StringType()),
        T.StructField("layout", T.StringType()),
    ]
)
# A table's folders, each with the parts that are read from it.
Layout = dict[str, list[int]]


class KeyViolation(ValueError):
    """Result tables that break a key, and so are not shown."""


class Superseded(RuntimeError):
    """Results to be amended that another run has replaced meanwhile."""


def current_jobs(log: DataFrame) -> DataFrame:
    """The latest row of each job."""
    newest = Window.partitionBy("id").orderBy(F.desc("revision"))
    return log.withColumn("__place", F.row_number().over(newest)).where("__place = 1").drop("__place")


def prediction_rows(scored: DataFrame, job_id: int, scoring_date: datetime | None = None) -> DataFrame:
    """The prediction columns, with the job and its time unless the rows carry one."""
    rows = scored.withColumn("scoring_job_id", F.lit(job_id).cast("int"))
    if "scoring_date" not in scored.columns:
        rows = rows.withColumn("scoring_date", F.lit(scoring_date).cast("timestamp"))
    return rows.select(*schemas.PREDICTIONS.names)


def segment_rows(segments: DataFrame) -> DataFrame:
    return segments.select(*schemas.SEGMENTS.names)


def recommendation_rows(recommendations: DataFrame) -> DataFrame:
    return recommendations.select(*schemas.RECOMMENDATIONS.names)


def differing_parts(old: DataFrame, new: DataFrame, buckets: int) -> list[int]:
    """Parts in which rows were changed, added or removed. Tables bucketed alike are not shuffled."""
    columns = [c for c in old.columns if c != KEY]
    before = old.select(KEY, F.lit(True).alias("__old"), *(F.col(c).alias(f"__{c}") for c in columns))
    after = new.select(KEY, F.lit(True).alias("__new"), *columns)
    differs = [~F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns] + [F.col("__old").isNull(), F.col("__new").isNull()]
    changed = before.join(after, KEY, "full").where(reduce(or_, differs))
    # At most ``MOST_PARTS`` values.
    return sorted(r["part"] for r in changed.select(part_of(buckets).alias("part")).distinct().collect())


def key_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """``problem`` and ``key_value`` of every broken key: repeated or NULL customers per table, and rows without
    a prediction. Result tables are bucketed by customer, so no row is moved.
    """
    found = []
    for name, df in tables.items():
        kept = quality.key_problems(df.select(KEY), KEY).select(F.lit(f"{name}: repeated or missing key").alias("problem"), "key_value")
        found.append(kept)
        if name != "predictions":
            lost = quality.orphans(df.select(KEY), tables["predictions"], KEY)
            found.append(lost.select(F.lit(f"{name}: no prediction").alias("problem"), F.col(KEY).alias("key_value")))
    return reduce(DataFrame.unionByName, found)


class ResultStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets = buckets
        self._log = Log(spark, f"{self.root}/scoring_jobs", LOG_SCHEMA)
        self._written: dict[tuple[str, str], list[int]] = {}

    # Job log

    def log(self) -> DataFrame:
        """All rows of the job log."""
        return self._log.rows()

    def jobs(self) -> DataFrame:
        """The current state of each job."""
        return current_jobs(self.log()).select(*schemas.SCORING_JOBS.names)

    def _job(self, job_id: int, rows: DataFrame | None = None) -> dict | None:
        """The current row of one job."""
        own = (self.log() if rows is None else rows).where(F.col("id") == F.lit(job_id).cast("int"))
        row = own.agg(F.max_by(F.struct(*LOG_SCHEMA.names), "revision").alias("job")).first()["job"]
        return row.asDict() if row else None

    def create_job(self, result: dict, status: str = "running") -> int:
        """Log a job and return its id. ``result`` holds the model and its test metrics."""

        def entry(rows: DataFrame) -> dict:
            return {
                "id": (rows.agg(F.max("id")).first()[0] or 0) + 1,
                "model_name": result.get("model_name", "Churn prediction model"),
                "model_version": result.get("model_version", "1.0"),
                "algorithm": result.get("algorithm", "Gradient Boosting"),
                "roc_auc": result.get("roc_auc"),
                "f1_score": result.get("f1_score"),
                "recall": result.get("recall"),
                "high_risk_threshold": L.HIGH_RISK,
                "medium_risk_threshold": L.MEDIUM_RISK,
                "status": status,
                "scoring_date": datetime.now(timezone.utc),
            }

        return self._log.append(entry)["id"]

    def update_status(self, job_id: int, status: str, **changes) -> None:
        """Append the job's row with a new status; an unknown id changes nothing."""

        def entry(rows: DataFrame) -> dict | None:
            row = self._job(job_id, rows)
            return None if row is None else {**row, **changes, "status": status}

        self._log.append(entry)

    # Result tables

    def bucket_count(self, rows: DataFrame) -> int:
        """The store's bucket count, or one that fits the number of rows."""
        return self.buckets or buckets_for(rows.count())

    def _read(self, table: str, layout: Layout, buckets: int, only: list[int] | None = None) -> DataFrame:
        return read_parts(self.spark, f"{self.root}/{table}", layout, TABLES[table], buckets, only=only)

    def _save(self, table: str, folder: str, rows: DataFrame, buckets: int) -> list[int]:
        parts = write_parts(rows.select(*TABLES[table].names), f"{self.root}/{table}/{folder}", buckets)
        if table == "predictions":
            write_grams(self._read(table, {folder: parts}, buckets).select(KEY), self._grams(folder), buckets)
        return parts

    def _grams(self, folder: str) -> str:
        return f"{self.root}/id_grams/{folder}"

    def _search_parts(self, layout: Layout, text: str) -> list[int]:
        """Parts that can hold ids found by a search."""
        found = set()
        for folder, parts in layout.items():
            held = parts_with(self.spark, self._grams(folder), text)
            found |= set(parts) if held is None else held & set(parts)
        return sorted(found)

    def write(self, table: str, folder: str, rows: DataFrame, buckets: int) -> DataFrame:
        """Write one result table to a run's folder and return it as written.

        Readers do not see it before ``commit``. Rows already bucketed alike are
        not shuffled again.
        """
        parts = self._save(table, folder, rows, buckets)
        self._written[table, folder] = parts
        return self._read(table, {folder: parts}, buckets)

    def commit(self, job_id: int, folder: str, buckets: int, layouts: dict[str, Layout] | None = None, replaces: int | None = None) -> None:
        """Make a run's folder the one readers see, unless its tables break a key.

        ``layouts`` names the folders of each table where they are not all ``folder``; ``replaces`` is the
        revision of the results that were amended, which have to be the latest still.
        """
        layouts = layouts or {t: {folder: self._written[t, folder]} for t in TABLES}
        broken = key_violations({t: self._read(t, layouts[t], buckets) for t in TABLES}).take(5)
        if broken:
            raise KeyViolation("; ".join(f"{r['problem']} {r['key_value']}" for r in broken))

        def entry(rows: DataFrame) -> dict | None:
            latest = self._latest(rows)
            if replaces is not None and (latest is None or latest["revision"] != replaces):
                raise Superseded("other results were published since these were read")
            row = self._job(job_id, rows)
            text = json.dumps(layouts)
            return None if row is None else {**row, "status": "success", "folder": folder, "buckets": buckets, "layout": text}

        self._log.append(entry)

    def write_predictions(self, job_id: int, scored: DataFrame, buckets: int) -> DataFrame:
        job = self._job(job_id)
        if job is None:
            raise ValueError(f"Unknown scoring job: {job_id}")
        rows = prediction_rows(scored, job_id, job["scoring_date"])
        return self.write("predictions", f"job_{job_id}", rows, buckets)

    def publish(
        self, job_id: int, scored: DataFrame, segments: DataFrame, recommendations: DataFrame
    ) -> None:
        """Replace all three result tables and mark the job successful."""
        folder, buckets = f"job_{job_id}", self.bucket_count(scored)
        self.write_predictions(job_id, scored, buckets)
        self.write("customer_segments", folder, segment_rows(segments), buckets)
        self.write("customer_recommendations", folder, recommendation_rows(recommendations), buckets)
        self.commit(job_id, folder, buckets)

    def _latest(self, rows: DataFrame | None = None):
        done = current_jobs(self.log() if rows is None else rows).where(F.col("status") == "success")
        return done.orderBy(F.desc("revision")).select("id", "revision", "buckets", "folder", "layout").first()

    @contextmanager
    def amending(self) -> Iterator[Callable[[str, DataFrame], DataFrame]]:
        """Replace rows of the result tables of the latest success, as a reconciliation does.

        Gives a function that takes all rows of one table, writes the parts in which some differ to a folder
        of the amendment's own, and returns the table as amended. Readers see the new tables when the block
        ends; if it raises, or other results were published meanwhile, they never do.
        """
        latest = self._latest()
        if latest is None:
            raise ValueError("There are no results to amend.")
        folder = f"job_{latest['id']}_amended_{uuid.uuid4().hex[:12]}"
        before, buckets = json.loads(latest["layout"]), latest["buckets"]
        layouts: dict[str, Layout] = {}

        def save(table: str, rows: DataFrame) -> DataFrame:
            rows, layout = rows.select(*TABLES[table].names), before[table]
            touched = differing_parts(self._read(table, layout, buckets), rows, buckets)
            if touched:
                rows = rows.where(part_of(buckets).isin(touched))
                written = self._save(table, folder, rows, buckets)
                layout = {f: [p for p in parts if p not in touched] for f, parts in layout.items()}
                layout = {f: parts for f, parts in {**layout, folder: written}.items() if parts}
            layouts[table] = layout
            return self._read(table, layout, buckets)

        yield save
        if missing := set(TABLES) - set(layouts):
            raise ValueError(f"not amended: {', '.join(sorted(missing))}")
        self.commit(latest["id"], folder, buckets, layouts, latest["revision"])

    def amend(self, tables: dict[str, DataFrame]) -> None:
        """Replace all result tables of the latest success by the given ones."""
        with self.amending() as save:
            for table in TABLES:
                save(table, tables[table])

    def vacuum(self, keep: int = 1) -> list[str]:
        """Remove the folders of superseded runs and their tables; return the names of those removed.

        What the published run and the ``keep - 1`` successes before it read stays, and so does every folder
        that the log does not name as a success: a run may be writing it.
        """
        if keep < 1:
            raise ValueError("the published run is always kept")
        done = self.log().where((F.col("status") == "success") & F.col("folder").isNotNull())
        newest = done.orderBy(F.desc("revision")).select("folder", "layout").collect()
        read = {f for r in newest[:keep] for layout in json.loads(r["layout"]).values() for f in layout}
        gone = []
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for folder in dict.fromkeys(r["folder"] for r in newest[keep:]):
            if folder in read:
                continue
            found = False
            for table in TABLES:
                path = f"{self.root}/{table}/{folder}"
                self.spark.sql(f"DROP TABLE IF EXISTS {table_name(path)}")
                target = jvm.org.apache.hadoop.fs.Path(path)
                found |= target.getFileSystem(conf).delete(target, True)
            if exists(self.spark, self._grams(folder)):
                target = jvm.org.apache.hadoop.fs.Path(self._grams(folder))
                target.getFileSystem(conf).delete(target, True)
            if found:
                gone.append(folder)
        return gone

    def published(self, search: str | None = None) -> dict[str, DataFrame]:
        """The result tables of the latest success; empty tables before the first one.

        With the text of a ``search``, only the parts that can hold what it finds; the rows are still to be
        filtered by ``CustomerFilter(search=...)``.
        """
        row = self._latest()
        if row is None:
            return {name: self.spark.createDataFrame([], schema) for name, schema in TABLES.items()}
        layouts = json.loads(row["layout"])
        only = self._search_parts(layouts["predictions"], search) if search else None
        return {name: self._read(name, layouts[name], row["buckets"], only) for name in TABLES}
