"""A numbered log that several writers may append to.

Every entry is a file of its own, named by its number, and comes into being whole and at most once: it
is written beside the log and then given its name, which fails if another writer has taken the number.
A writer that loses reads the log again and tries the next number, so what it derives from the log
(ids, versions, whether it may still replace what it has read) always holds for the entry it adds.

Local folders are linked to (``link`` fails for a name that exists); other file systems rename, which has
to fail for a name that exists, as HDFS does. Object stores need a file system layer that keeps this.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

NUMBER = "revision"


def _plain(value):
    if isinstance(value, datetime):
        return value.astimezone(timezone.utc).isoformat()
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


class Log:
    """Entries with the columns of ``schema``, among them ``revision``, the entry's number."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.schema = spark, path, schema
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def rows(self) -> DataFrame:
        """All entries."""
        try:
            return self.spark.read.schema(self.schema).json(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.schema)

    def append(self, entry: Callable[[DataFrame], dict | None]) -> dict | None:
        """Add the entry that ``entry`` makes of the log's rows, and return it.

        ``entry`` is called again, with the rows as they then are, whenever another writer was first. It may
        return None to add nothing, or raise.
        """
        while True:
            rows = self.rows()
            values = entry(rows)
            if values is None:
                return None
            last = rows.agg(F.coalesce(F.max(NUMBER), F.lit(0))).first()[0]
            values = {f.name: values.get(f.name) for f in self.schema.fields} | {NUMBER: last + 1}
            if self._create(last + 1, json.dumps({k: _plain(v) for k, v in values.items()})):
                return values

    def _create(self, number: int, text: str) -> bool:
        """Give the entry its number; False if another entry has it."""
        jvm = self._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{number:020d}.json")
        draft = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_{uuid.uuid4().hex}")
        files = target.getFileSystem(self._conf)
        out = files.create(draft, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        try:
            if files.getUri().getScheme() != "file":
                return not files.exists(target) and files.rename(draft, target)
            places = [jvm.java.nio.file.Paths.get(files.makeQualified(p).toUri()) for p in (target, draft)]
            jvm.java.nio.file.Files.createLink(*places)
            return True
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                raise
            return False
        finally:
            files.delete(draft, False)
