"""Removal of long word sequences that occur more than once (operator 3).

Seed and extend. Every window of ``length`` words has one anchor: of its ``seed``-word sequences the
one with the least name, the rightmost on ties (winnowing). Equal windows have equal anchors at equal
places, so two copies always meet at an anchor. Neighbouring windows with one anchor form a *run*.

1. Seeds: runs are counted by anchor and by content; an anchor that occurs once ends here.
2. A run whose whole content occurs again is a repeat from end to end.
3. Extension: other runs at a shared anchor are extended to both sides window by window, against the
   distinct runs of that anchor; counts stand for copies, so no pairs are formed.
4. Overlapping and adjacent repeated windows of a document merge to maximal repeats.

Nothing is capped. Hot anchors are combined before the shuffles, joins on them can be split by
adaptive execution, and what is gathered per document is bounded by the document.

Defined results: null and empty texts have no words; documents under ``length`` words keep all of
them; rows with equal id and text count as copies of each other; null ids stay null; other columns
do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from holdfast.llm.tables import KEYS, keyed, read_table, saved
from holdfast.llm.words import Namer, Words, signed, slices

LENGTH = 35
SEED = 8

# Bits that hold a word's place in the order of seeds; a text has fewer words than 2^30.
_PLACE = np.uint64((1 << 30) - 1)


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Least value of every ``size`` neighbours, by doubling."""
    step = 1
    while 2 * step <= size:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    rest = size - step
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def runs_of(words: Words, length: int, seed: int):
    """Document, first window, number of windows, anchor and content of each run in a slice."""
    count = len(words) - length + 1
    if count <= 0:
        return None
    grams = words.grams(seed)
    places = np.arange(len(grams), dtype=np.uint64)
    least = sliding_min((grams & ~_PLACE) | (_PLACE - places), length - seed + 1)
    owner = (_PLACE - (least & _PLACE)).astype(np.int64)
    windows = np.flatnonzero(np.arange(count) + length <= words.last()[:count])
    if not len(windows):
        return None
    owner, document = owner[windows], words.documents()[windows]
    new = np.flatnonzero((np.diff(owner) != 0) | (np.diff(document) != 0)) + 1
    begin, end = np.concatenate(([0], new)), np.concatenate((new, [len(windows)]))
    first, size, at = windows[begin], end - begin, owner[begin]
    content = words.stretch(first, first + size - 1 + length) + (at - first).astype(np.uint64)
    return document[begin], first, size, grams[at], content


def _runs(batches: Iterator[pa.RecordBatch], length: int, seed: int) -> Iterator[pa.RecordBatch]:
    namer = Namer()
    for batch, texts in slices(batches):
        words = namer.words(texts)
        found = runs_of(words, length, seed)
        if found is None:
            continue
        document, first, size, anchor, content = found
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(i).take(pa.array(document)) for i in (0, 1)),
                pa.array((first - words.firsts[document]).astype(np.int32)),
                pa.array(size.astype(np.int32)),
                pa.array(signed(anchor)),
                pa.array(signed(content)),
            ],
            names=[*KEYS, "begin", "size", "anchor", "content"],
        )


def spread(lists: pa.ListArray, fields: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    """Row number and fields of all entries of a column of struct lists."""
    entries = lists.flatten()
    rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    return (rows, *(np.asarray(entries.field(entries.type.get_field_index(f))) for f in fields))


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """One row for each window of the runs to extend."""
    namer = Namer()
    for batch, texts in slices(batches):
        words = namer.words(texts)
        row, begin, size, anchor, copies = spread(batch.column(3), ("begin", "size", "anchor", "copies"))
        each = np.repeat(np.arange(len(row)), size)
        place = begin[each] + np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size)
        start = words.firsts[row[each]] + place
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(i).take(pa.array(row[each])) for i in (0, 1)),
                pa.array(place.astype(np.int32)),
                pa.array(anchor[each]),
                pa.array(signed(words.stretch(start, start + length))),
                pa.array(copies[each]),
            ],
            names=[*KEYS, "begin", "anchor", "content", "copies"],
        )


def repeated_windows(rows: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """Stretches ``begin``, ``size`` (in windows) of repeated windows, by row key. ``rows`` as from ``keyed``."""
    if length < seed:
        raise ValueError("a seed is no longer than a repeat")
    texts = rows.select(*KEYS, "text")
    runs = saved(
        texts.mapInArrow(
            lambda batches: _runs(batches, length, seed),
            "row_id long, row_text long, begin int, size int, anchor long, content long",
        )
    )
    shared = saved(runs.groupBy("anchor").agg(F.count("*").alias("total")).filter("total > 1"))
    kinds = saved(
        runs.groupBy("anchor", "content")
        .agg(F.count("*").alias("copies"), F.min(F.struct(*KEYS, "begin", "size")).alias("one"))
        .join(shared, "anchor")
    )
    whole = runs.join(kinds.filter("copies > 1").select("anchor", "content"), ["anchor", "content"], "left_semi")
    extend = (
        kinds.filter("copies < total")
        .select("one.*", "anchor", "copies")
        .groupBy(*KEYS)
        .agg(F.collect_list(F.struct("begin", "size", "anchor", "copies")).alias("runs"))
    )
    windows = saved(
        texts.join(extend, list(KEYS)).mapInArrow(
            lambda batches: _windows(batches, length),
            "row_id long, row_text long, begin int, anchor long, content long, copies long",
        )
    )
    again = saved(
        windows.groupBy("anchor", "content").agg(F.sum("copies").alias("total")).filter("total > 1").drop("total")
    )
    single = windows.filter("copies = 1").join(again, ["anchor", "content"], "left_semi")
    return whole.select(*KEYS, "begin", "size").unionByName(single.select(*KEYS, "begin", F.lit(1).alias("size")))


def _kept(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches):
        words = [t.split() for t in texts]
        row, begin, size = spread(batch.column(2).fill_null([]), ("begin", "size"))
        firsts = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
        change = np.zeros(firsts[-1] + 1, dtype=np.int64)
        np.add.at(change, firsts[row] + begin, 1)
        np.add.at(change, firsts[row] + begin + size - 1 + length, -1)
        stays = np.cumsum(change)[:-1] == 0
        stay = [stays[a:b] for a, b in zip(firsts, firsts[1:])]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(w) for w in words], pa.int64()),
                pa.array([int(len(s) - s.sum()) for s in stay], pa.int64()),
                pa.array([b" ".join(compress(w, s.tolist())).decode() for w, s in zip(words, stay)], pa.string()),
            ],
            names=["doc_id", "n_words", "n_removed", "kept"],
        )


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and the ``kept`` words joined by one space, a row per document."""
    rows = keyed(docs)
    found = (
        repeated_windows(rows, length, seed)
        .groupBy(*KEYS)
        .agg(F.collect_list(F.struct("begin", "size")).alias("repeats"))
    )
    return (
        rows.join(found, list(KEYS), "left")
        .select("doc_id", "text", "repeats")
        .mapInArrow(
            lambda batches: _kept(batches, length), "doc_id long, n_words long, n_removed long, kept string"
        )
    )


def maximal_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``first_word``, ``last_word`` of every maximal stretch of repeated windows."""
    rows = keyed(docs)
    order = Window.partitionBy(*KEYS).orderBy("begin", "end")
    spans = repeated_windows(rows, length, seed).distinct().withColumn("end", F.col("begin") + F.col("size") - 1 + length)
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    joined = spans.withColumn("new", F.when(before >= F.col("begin"), 0).otherwise(1)).withColumn(
        "part", F.sum("new").over(order)
    )
    merged = joined.groupBy(*KEYS, "part").agg(
        F.min("begin").alias("first_word"), (F.max("end") - 1).alias("last_word")
    )
    return rows.drop("text").join(merged, list(KEYS)).select("doc_id", "first_word", "last_word")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


OP3_SQL = """
WITH texts AS (
    SELECT doc_id, REGEXP_EXTRACT_ALL(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), starts AS (
    SELECT doc_id, words, UNNEST(RANGE(1, LENGTH(words) - 33)) AS first FROM texts WHERE LENGTH(words) >= 35
), windows AS (
    SELECT doc_id, first, ARRAY_TO_STRING(words[first:first + 34], ' ') AS content FROM starts
), again AS (
    SELECT doc_id, first FROM windows WHERE content IN (SELECT content FROM windows GROUP BY content HAVING COUNT(*) > 1)
), removed AS (
    SELECT doc_id, LIST(DISTINCT place) AS places
    FROM (SELECT doc_id, UNNEST(RANGE(first, first + 35)) AS place FROM again) GROUP BY doc_id
), kept AS (
    SELECT t.doc_id, words, COALESCE(LENGTH(places), 0) AS n_removed,
        LIST_FILTER(words, LAMBDA w, i: NOT COALESCE(LIST_CONTAINS(places, i), FALSE)) AS stay
    FROM texts t LEFT JOIN removed r ON t.doc_id = r.doc_id
)
SELECT doc_id, LENGTH(words) AS n_words, n_removed, SHA256(ARRAY_TO_STRING(stay, ' ')) AS kept_sha256 FROM kept
"""
