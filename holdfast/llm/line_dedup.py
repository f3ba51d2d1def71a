"""Removal of lines that many documents share (operator 9).

Sharded minimal perfect hash. Lines get 128-bit names. Distinct names fall into shards of bounded size
by their first bits; a shard is a minimal perfect hash (levels of bit arrays), which gives every name
of the shard its own slot, an array of 64-bit fingerprints and an array of document counts. Slot and
fingerprint together take in all 128 bits, so a name that is not in the index is told apart.

Documents do not join lines. Each part of a split keeps the distinct names of its lines as one
*packet*; the packet sends each shard one array of names and gets one array of counts back. A line of
every document is thus sent once per packet, not once per document. A shard that gets more than
``HOT_NAMES`` names, as one with such a line does, is split by packet: its parts are counted before the
shard is built, and each part is probed with its own copy of the shard.

Defined results: null and empty texts are one empty line, which has no key and stays; a document
counts once for a line however often it has it; rows with equal id and text are documents of their
own; null ids stay null; a document may lose all lines, its text is then empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.tables import KEYS, keyed, read_table, saved, whole, with_text
from holdfast.llm.words import encoded, mix, slices

MIN_DOCUMENTS = 10
# Names of lines that packets hold, over this, is the number of shards: it bounds what a task holds.
SHARD_NAMES = 1 << 18
LEAST_SHARDS = 64
# Names that a shard gets before it is split.
HOT_NAMES = 4 * SHARD_NAMES

NAME = np.dtype([("first", ">u8"), ("second", ">u8")])


def line_key(line: bytes) -> bytes:
    return line.strip(b" \t\n\x0b\x0c\r").lower()


def line_names(text: bytes, min_chars: int) -> list[bytes]:
    """A 16-byte name for each line, empty for lines whose key is too short to be dropped."""
    keys = map(line_key, text.split(b"\n"))
    return [
        xxhash.xxh3_128_digest(k) if len(k) >= min_chars and len(k.decode()) >= min_chars else b"" for k in keys
    ]


# ---- minimal perfect hash


def _slots(first: np.ndarray, second: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))
    return (mix(first ^ mix(second + salt)) % np.uint64(size)).astype(np.int64)


def build_hash(first: np.ndarray, second: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Sizes of the levels and all their bits: at each level, names alone at their slot take it."""
    sizes, bits = [], []
    while len(first):
        size = max(64, 2 * len(first))
        slot = _slots(first, second, len(sizes), size)
        alone = np.bincount(slot, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        rest = ~alone[slot]
        first, second = first[rest], second[rest]
    return sizes, np.concatenate(bits) if bits else np.zeros(0, dtype=bool)


def find_slots(sizes: list[int], bits: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Place of each name among the set bits; -1 for names that reach no set bit."""
    ranks, found, base = np.cumsum(bits) - 1, np.full(len(first), -1, dtype=np.int64), 0
    open_ = np.arange(len(first))
    for level, size in enumerate(sizes):
        slot = base + _slots(first[open_], second[open_], level, size)
        hit = bits[slot]
        found[open_[hit]] = ranks[slot[hit]]
        open_, base = open_[~hit], base + size
    return found


# ---- packets


def _packets(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for batch, texts in slices(batches):
        names = [line_names(t, min_chars) for t in texts]
        places = {n: i for i, n in enumerate(sorted({n for own in names for n in own if n}))}
        documents = np.zeros(len(places), dtype=np.uint32)
        for own in names:
            documents[[places[n] for n in set(own) if n]] += 1
        lines = [np.array([places.get(n, -1) for n in own], dtype=np.int32).tobytes() for own in names]
        listed = pa.StructArray.from_arrays(
            [batch.column(0), batch.column(1), pa.array(lines, pa.binary())], names=[*KEYS, "lines"]
        )
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()),
                pa.array([b"".join(places)], pa.binary()),
                pa.array([documents.tobytes()], pa.binary()),
                pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), listed),
            ],
            names=["packet", "names", "documents", "rows"],
        )
        number += 1


def _pieces(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """The names of a packet by shard. Names are sorted, and shards are ranges of names."""
    for batch in batches:
        for packet, names, documents in zip(*(batch.column(i).to_pylist() for i in range(3))):
            found = np.frombuffer(names, dtype=NAME)
            if not len(found):
                continue
            shard = (found["first"].astype(np.uint64) // np.uint64((1 << 64) // shards)).astype(np.int64)
            shard = np.minimum(shard, shards - 1)
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shard[cuts[:-1]].astype(np.int32)),
                    pa.array([packet] * (len(cuts) - 1), pa.int64()),
                    pa.array([names[16 * a : 16 * b] for a, b in zip(cuts, cuts[1:])], pa.binary()),
                    pa.array([documents[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:])], pa.binary()),
                ],
                names=["shard", "packet", "names", "documents"],
            )


PIECE = "shard int, packet long, names binary, documents binary"


def packets_of(rows: DataFrame, min_chars: int = 1) -> DataFrame:
    return saved(
        rows.select(*KEYS, "text").mapInArrow(
            lambda batches: _packets(batches, min_chars),
            "packet long, names binary, documents binary, "
            "rows array<struct<row_id: long, row_text: long, lines: binary>>",
        )
    )


def shard_count(packets: DataFrame) -> int:
    names = packets.agg(F.sum(F.octet_length("names"))).first()[0] or 0
    return max(LEAST_SHARDS, -(-names // (16 * SHARD_NAMES)))


def pieces_of(packets: DataFrame, shards: int) -> DataFrame:
    return packets.select("packet", "names", "documents").mapInArrow(lambda b: _pieces(b, shards), PIECE)


def hot_shards(packets: DataFrame, shards: int) -> DataFrame:
    """``shard``, ``parts``: the shards that get more than ``HOT_NAMES`` names, and into how many parts they go."""
    names = F.sum(F.octet_length("names")) / 16
    sizes = pieces_of(packets, shards).groupBy("shard").agg(F.ceil(names / HOT_NAMES).cast("int").alias("parts"))
    return saved(sizes.filter("parts > 1"))


def _column(table: pa.Table, name: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=dtype)


def _counted(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct names and their document counts."""
    names, documents = _column(table, "names", NAME), _column(table, "documents", np.uint32)
    distinct, which = np.unique(names, return_inverse=True)
    return distinct, np.bincount(which, weights=documents).astype(np.uint64)


def _combined(table: pa.Table) -> pa.Table:
    """The names of one part of a hot shard, each once. Counts beyond 32 bits stay at the largest."""
    names, documents = _counted(table)
    most = np.uint64(np.iinfo(np.uint32).max)
    return pa.table(
        {
            "shard": table.column("shard").slice(0, 1),
            "packet": table.column("packet").slice(0, 1),
            "names": pa.array([names.tobytes()], pa.binary()),
            "documents": pa.array([np.minimum(documents, most).astype(np.uint32).tobytes()], pa.binary()),
        }
    )


def _build(table: pa.Table) -> pa.Table:
    distinct, counts = _counted(table)
    first, second = distinct["first"].astype(np.uint64), distinct["second"].astype(np.uint64)
    sizes, bits = build_hash(first, second)
    slot = find_slots(sizes, bits, first, second)
    prints, held = np.empty_like(second), np.empty_like(counts)
    prints[slot], held[slot] = second, counts
    return pa.table(
        {
            "shard": table.column("shard").slice(0, 1),
            "sizes": pa.array([sizes], pa.list_(pa.int64())),
            "bits": pa.array([np.packbits(bits).tobytes()], pa.binary()),
            "prints": pa.array([prints.tobytes()], pa.binary()),
            "counts": pa.array([held.tobytes()], pa.binary()),
        }
    )


def _parted(pieces: DataFrame, hot: DataFrame) -> DataFrame:
    """Pieces with the ``part`` of their shard, which is 0 where it is not split."""
    return pieces.join(hot, "shard", "left").withColumn("part", F.coalesce(F.pmod(F.hash("packet"), "parts"), F.lit(0)))


def line_index(packets: DataFrame, shards: int, hot: DataFrame) -> DataFrame:
    """One row per shard: the minimal perfect hash, the fingerprints and the document counts."""
    pieces = _parted(pieces_of(packets, shards), hot)
    names = ["shard", "packet", "names", "documents"]
    parts = pieces.filter("parts IS NOT NULL").select("part", *names)
    combined = parts.groupBy("shard", "part").applyInArrow(_combined, PIECE)
    rows = pieces.filter("parts IS NULL").select(*names).unionByName(combined)
    return saved(
        rows.groupBy("shard").applyInArrow(
            _build, "shard int, sizes array<long>, bits binary, prints binary, counts binary"
        )
    )


def look_up(index: pa.Table, names: np.ndarray) -> np.ndarray:
    """Document counts of names in one shard; 0 where the index lacks the name."""
    sizes = index.column("sizes")[0].as_py()
    bits = np.unpackbits(np.frombuffer(index.column("bits")[0].as_py(), dtype=np.uint8))[: sum(sizes)].astype(bool)
    prints = np.frombuffer(index.column("prints")[0].as_py(), dtype=np.uint64)
    counts = np.frombuffer(index.column("counts")[0].as_py(), dtype=np.uint64)
    first, second = names["first"].astype(np.uint64), names["second"].astype(np.uint64)
    slot = find_slots(sizes, bits, first, second)
    known = (slot >= 0) & (prints[slot] == second)
    return np.where(known, counts[slot], 0)


def _probe(pieces: pa.Table, index: pa.Table, min_documents: int) -> pa.Table:
    names = _column(pieces, "names", NAME)
    if index.num_rows and len(names):
        common = look_up(index, names) >= min_documents
    else:
        common = np.zeros(len(names), dtype=bool)
    each = common.astype(np.uint8).tobytes()
    ends = np.cumsum([0] + [len(n) // 16 for n in pieces.column("names").to_pylist()])
    return pa.table(
        {
            "packet": pieces.column("packet"),
            "shard": pieces.column("shard"),
            "common": pa.array([each[a:b] for a, b in zip(ends, ends[1:])], pa.binary()),
        }
    )


def _flags(packets: pa.Table, answers: pa.Table) -> pa.Table:
    """Per document with common lines, a byte per line. Answers in order of shards are in order of names."""
    order = np.argsort(answers.column("shard").to_numpy(), kind="stable").tolist()
    parts = answers.column("common").to_pylist()
    common = np.frombuffer(b"".join(parts[i] for i in order) + b"\0", dtype=np.uint8)
    ids, texts, flags = [], [], []
    for rows in packets.column("rows").to_pylist():
        for row in rows:
            own = common[np.frombuffer(row["lines"], dtype=np.int32)]
            if own.any():
                ids.append(row["row_id"])
                texts.append(row["row_text"])
                flags.append(own.tobytes())
    return pa.table(
        {"row_id": pa.array(ids, pa.int64()), "row_text": pa.array(texts, pa.int64()), "common": pa.array(flags, pa.binary())}
    )


def common_lines(
    packets: DataFrame, index: DataFrame, shards: int, hot: DataFrame, min_documents: int = MIN_DOCUMENTS
) -> DataFrame:
    """Row keys of documents with common lines, and a byte per line that tells which are."""
    pieces = _parted(pieces_of(packets, shards), hot).select("packet", "shard", "part", "names")
    part = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    copies = index.join(hot, "shard", "left").withColumn("part", part).drop("parts")
    answers = (
        pieces.groupBy("shard", "part")
        .cogroup(copies.groupBy("shard", "part"))
        .applyInArrow(lambda a, b: _probe(a, b, min_documents), "packet long, shard int, common binary")
    )
    return (
        packets.select("packet", "rows")
        .groupBy("packet")
        .cogroup(answers.groupBy("packet"))
        .applyInArrow(_flags, "row_id long, row_text long, common binary")
    )


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, lines, dropped = [], [], []
        for text, flags in zip(encoded(batch.column(1)), batch.column(2).to_pylist()):
            own = text.split(b"\n")
            lines.append(len(own))
            dropped.append(sum(flags) if flags else 0)
            kept.append(b"\n".join(compress(own, (not f for f in flags))) if flags else text)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(lines, pa.int64()),
                pa.array(dropped, pa.int64()),
                pa.array([k.decode() for k in kept], pa.string()),
            ],
            names=["row", "n_lines", "n_dropped", "kept"],
        )


def drop_common_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_chars: int = 1) -> DataFrame:
    """A row per document: ``row`` (its columns but the text), ``n_lines``, ``n_dropped``, ``kept``."""
    packets = packets_of(keyed(docs), max(1, min_chars))
    shards = shard_count(packets)
    hot = hot_shards(packets, shards)
    index = line_index(packets, shards, hot)
    flags = common_lines(packets, index, shards, hot, min_documents).dropDuplicates(list(KEYS))
    rows = whole(docs)
    kind = rows.schema["row"].dataType.simpleString()
    return (
        rows.join(flags, list(KEYS), "left")
        .select("row", "text", "common")
        .mapInArrow(_kept, f"row {kind}, n_lines long, n_dropped long, kept string")
    )


def without_common_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``docs`` with their common lines gone and ``n_chars`` in step."""
    return with_text(drop_common_lines(docs, min_documents), docs, "kept")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_common_lines(read_table(spark, sf_dir, "documents")).select(
        F.col("row.doc_id").alias("doc_id"),
        "n_lines",
        "n_dropped",
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
    )


OP9_SQL = """
WITH blanks AS (SELECT ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS b),
lines AS (
    SELECT doc_id, UNNEST(STRING_SPLIT(COALESCE(text, ''), chr(10))) AS line,
        UNNEST(RANGE(LENGTH(STRING_SPLIT(COALESCE(text, ''), chr(10))))) AS place
    FROM documents
), keys AS (
    SELECT doc_id, line, place,
        TRANSLATE(TRIM(line, b), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines, blanks
), common AS (
    SELECT key FROM keys WHERE key <> '' GROUP BY key HAVING COUNT(DISTINCT doc_id) >= 10
), marked AS (
    SELECT k.*, c.key IS NOT NULL AS dropped FROM keys k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, COUNT(*) AS n_lines, COUNT(*) FILTER (dropped) AS n_dropped,
    SHA256(COALESCE(STRING_AGG(line, chr(10) ORDER BY place) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
