"""Packing of documents into sequences of bounded length (operator 10).

Order-preserving dynamic programming. A task reads its part of the table in order and lays the tokens
of its documents end to end, each closed by an end id. Cuts may fall at ends of documents (free), at
ends of sentences (``SENTENCE_CUT``) and, only inside stretches longer than ``FREE_STEP`` without
either, at every ``FREE_STEP`` tokens (``FORCED_CUT``). The cost of a window is its padding plus the
penalty of its cut, both in tokens:

    cost(i) = penalty(i) + min over j of cost(j) + padding(p(i) - p(j)),  p(i) - p(j) <= size

Padding is ``size`` less the length, so the minimum is that of ``cost(j) + p(j)`` over a sliding range,
which a monotone queue keeps; lengths that are powers of two need no padding and are looked up. Tasks
solve ``CHUNK`` tokens at a time and carry the end over to the next chunk, so memory is bounded
and only the last window of a partition can be short. Nothing is shuffled.

Token ids are those of the ``tokenizers`` library for the given vocabulary. Plain texts (ASCII and
Latin letters), where both libraries split alike, are encoded by ``tiktoken`` with the same
vocabulary, which takes a quarter of the time; all others by ``tokenizers`` itself.

Defined results: null and empty texts are one end id; a document of any length is cut as often as it
needs; repeated rows and null ids are documents of their own; sequence numbers follow the partitions of
the input, and a task that runs again makes the same pieces.
"""

from __future__ import annotations

import base64
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.tables import read_table

SIZE = 2048
END_ID = 1
SENTENCE_CUT, FORCED_CUT, FREE_STEP = 4, 64, 128
# Shortest power of two that is used as an unpadded sequence.
LEAST_POWER = 128
CHUNK = 1 << 18

# Characters that a text is cut after when it is encoded in parts, and texts that both libraries split alike.
LONG_TEXT = 1 << 20
_PLAIN = re.compile(r"[^\t\n\r\x20-\x7eÀ-ÖØ-öø-ſ]")
_SPLIT = re.compile(r"(?<=[a-z]) (?=[a-z])")
_SPECIAL = "<|endoftext|>"


class Encoder:
    """Ids of texts, and which ids end a sentence; one per task."""

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.fast = tiktoken.Encoding(
            vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.sentence_end = np.zeros(max(self.exact.get_vocab_size(), max(ranks.values()) + 1), dtype=bool)
        self.sentence_end[[i for token, i in ranks.items() if token.rstrip(b" ")[-1:] in (b".", b"!", b"?", b"\n")]] = True

    def part(self, text: str) -> np.ndarray:
        if _PLAIN.search(text) is None and _SPECIAL not in text:
            return np.array(self.fast.encode_ordinary(text), dtype=np.uint32)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def ids(self, text: str) -> np.ndarray:
        """A long text goes in parts cut before single blanks between letters, where every token ends."""
        parts, start = [], 0
        while len(text) - start > LONG_TEXT and (cut := _SPLIT.search(text, start + LONG_TEXT)):
            parts.append(self.part(text[start : cut.start()]))
            start = cut.start()
        return np.concatenate([*parts, self.part(text[start:]), np.array([END_ID], dtype=np.uint32)])


def cut_points(lengths: list[int], sentence_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where tokens may be cut, from 0 to the end, and the penalties of cutting there.

    ``sentence_end`` tells of each token whether a sentence ends with it.
    """
    total = len(sentence_end)
    penalty = np.full(total + 1, -1, dtype=np.int64)
    penalty[np.flatnonzero(sentence_end) + 1] = SENTENCE_CUT
    penalty[np.cumsum([0, *lengths])] = 0
    penalty[total] = 0
    points = np.flatnonzero(penalty >= 0)
    gaps = np.diff(points)
    wide = gaps > FREE_STEP
    more = (gaps[wide] - 1) // FREE_STEP
    step = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
    forced = np.repeat(points[:-1][wide], more) + step * FREE_STEP
    penalty[forced] = FORCED_CUT
    points = np.flatnonzero(penalty >= 0)
    return points, penalty[points]


def best_cuts(points: np.ndarray, penalties: np.ndarray, size: int = SIZE) -> list[int]:
    """Places of the cuts that cost least, from the first point to the last."""
    powers = [1 << k for k in range(size.bit_length()) if LEAST_POWER <= 1 << k <= size]
    place, cost, came = points.tolist(), [0], [0]
    at = {place[0]: 0}
    queue: deque[tuple[int, int, int]] = deque([(place[0], place[0], 0)])  # cost + place, place, number
    for i, (here, penalty) in enumerate(zip(place[1:], penalties[1:].tolist()), 1):
        while here - queue[0][1] > size:
            queue.popleft()
        least, _, source = queue[0]
        least += size - here
        for power in powers:
            j = at.get(here - power)
            if j is not None and cost[j] < least:
                least, source = cost[j], j
        least += penalty
        cost.append(least)
        came.append(source)
        at[here] = i
        key = least + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, here, i))
    found, i = [], len(place) - 1
    while i:
        found.append(place[i])
        i = came[i]
    return [place[0], *reversed(found)]


class Packer:
    """Documents of one partition, in order."""

    def __init__(self, sentence_end: np.ndarray, size: int, sequence: int):
        self.sentence_end, self.size, self.sequence = sentence_end, size, sequence
        self.held: list[tuple[int | None, int, int, np.ndarray]] = []  # id, start, tokens of the document, ids
        self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        self.held.append((doc_id, 0, len(ids), ids))
        self.tokens += len(ids)
        if self.tokens >= CHUNK:
            yield from self.flush(2 * self.size)

    def flush(self, keep: int) -> Iterator[tuple]:
        """Pieces of all windows but those within the last ``keep`` tokens."""
        if not self.held:
            return
        ids = np.concatenate([h[3] for h in self.held])
        ends = np.cumsum([len(h[3]) for h in self.held])
        cuts = best_cuts(*cut_points([len(h[3]) for h in self.held], self.sentence_end[ids]), self.size)
        cuts = [c for c in cuts if c <= len(ids) - keep]
        document, base = 0, 0
        for begin, end in zip(cuts, cuts[1:]):
            place = begin
            while place < end:
                doc_id, start, tokens, _ = self.held[document]
                stop = min(end, int(ends[document]))
                yield doc_id, start + place - base, stop - place, ids[place:stop].astype("<u4").tobytes(), tokens, self.sequence, place - begin
                place = stop
                if stop == ends[document]:
                    document, base = document + 1, stop
            self.sequence += 1
        last = cuts[-1] if cuts else 0
        rest = []
        for k in range(document, len(self.held)):
            doc_id, start, tokens, own = self.held[k]
            skip = max(0, last - (int(ends[k]) - len(own)))
            if skip < len(own):
                rest.append((doc_id, start + skip, tokens, own[skip:]))
        self.held, self.tokens = rest, len(ids) - last


def _packed(batches: Iterator[pa.RecordBatch], vocabulary: str, size: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("start", pa.int64()),
            ("length", pa.int64()),
            ("ids", pa.binary()),
            ("doc_tokens", pa.int64()),
            ("sequence_id", pa.int64()),
            ("offset", pa.int64()),
        ]
    )

    def rows(found) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    encoder = Encoder(vocabulary)
    packer = Packer(encoder.sentence_end, size, TaskContext.get().partitionId() << 40)
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if found := list(packer.add(doc_id, encoder.ids(text.as_py() or ""))):
                yield rows(found)
    if found := list(packer.flush(0)):
        yield rows(found)


def pack(docs: DataFrame, size: int = SIZE, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """A row per piece: ``doc_id``, ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit),
    ``doc_tokens``, ``sequence_id``, ``offset``. ``size`` is a power of two.
    """
    if size < LEAST_POWER or size & (size - 1):
        raise ValueError(f"size is a power of two, {LEAST_POWER} at least")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lambda batches: _packed(batches, vocabulary, size),
        "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long",
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
