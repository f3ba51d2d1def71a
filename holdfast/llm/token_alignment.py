"""Alignment of two tokenizers' tokens, and how often tokens are linked (operator 13).

Both tokenizers cut the bytes of blank + text. Diagonal run skipping: while token k of one ends where
token k + shift of the other ends, groups are one-to-one. Windows of the two arrays of ends are compared
at the present shift, doubled while they agree and halved once they do not, which jumps over such a
stretch in few comparisons. Where it ends, the irregular group is resolved token by token up to the next
common end; its tokens that overlap are linked, and the shift changes by what one side has more.
Windows are compared as bytes, and the lowest bit in which they differ tells where the stretch ends.

How many documents hold a pair of ids linked is counted over the whole table. Documents of a split are
gathered to *packets* of about ``PACKET_BYTES`` of text. A packet lists its distinct id pairs with the
number of its documents that hold them: they are summed by pair (a pair that every document has arrives
once per packet), joined with the packets' pairs again, and each packet gets one answer per pair. What
a task holds is bounded by a packet, or by one document where that is longer.

Texts are encoded once. Neither tokenizer takes a special token's string for the token.

Defined results: null and empty texts, and texts that the tokens of one side do not give back byte for
byte, have no tokens: zeros, and an empty ``groups_sha256``; repeated rows and rows with a null id are
documents of their own; an empty table gives none; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.packing import Encoder
from holdfast.llm.tables import read_table, saved

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k", "piece_bpe_32k"
PACKET_BYTES = 8 << 20
# Tokens that are compared at first; words that a task keeps with their ids, and the characters of the longest.
FIRST_WINDOW, MOST_KNOWN, LONGEST_KNOWN = 16, 1 << 17, 32
_BLANK = re.compile(r"(?<=[a-z]) (?=[a-z])")

# ---- tokens


def _entries_a(encoder: Encoder) -> list[bytes]:
    """Bytes of each id of the byte-level vocabulary."""
    entries = [b""] * encoder.exact.get_vocab_size()
    for i in range(encoder.fast.n_vocab):
        entries[i] = encoder.fast.decode_single_token_bytes(i)
    return entries


class Tokens:
    """Ids of both tokenizers; one per task.

    Neither has a token that goes on behind a blank which stands alone between two words, so a text is
    encoded word by word, each with the blank before it, and frequent words are encoded once. Texts in
    which blanks follow each other, or stand at an end, are encoded in longer parts.
    """

    def __init__(self, vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B):
        import public_tokenizers
        import sentencepiece

        self.a = Encoder(vocabulary_a)
        self.a.exact.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{vocabulary_b}.model"))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.entries = (
            _entries_a(self.a),
            [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)],
        )
        self.lengths = tuple(np.array([len(e) for e in own], dtype=np.int32) for own in self.entries)
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece goes on behind a blank")
        # Ids of both sides by word, as bytes: words since the last turn, and those before.
        self.known: dict[str, tuple[bytes, bytes] | None] = {}
        self.older: dict[str, tuple[bytes, bytes] | None] = {}

    def parts(self, words: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of blank + word for each; none where one side does not give the bytes back."""
        text = " ".join(words)
        data = b" " + text.encode()
        last = np.cumsum([len(w) + 1 for w in (words if len(data) == len(text) + 1 else map(str.encode, words))])
        sides = []
        for ids, own, lengths in zip((self.a.ids(" " + text)[:-1], self.b.encode(text)), self.entries, self.lengths):
            ids = np.array(ids, dtype=np.int32)
            if b"".join(map(own.__getitem__, ids.tolist())) != data:
                return [None] if len(words) == 1 else [self.parts([w])[0] for w in words]
            ends = np.searchsorted(np.cumsum(lengths[ids]), last, side="right").tolist()
            raw = ids.tobytes()
            sides.append([raw[4 * a : 4 * b] for a, b in zip([0, *ends], ends)])
        return list(zip(*sides))

    def ids(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides; none for empty texts and those whose bytes do not come back."""
        if not text:
            return None
        words = text.split(" ")
        if "" in words:
            words = _BLANK.split(text)
        if len(self.known) > MOST_KNOWN:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = []
        for word in set(words):
            if word not in known:
                if word in older:
                    known[word] = older[word]
                else:
                    new.append(word)
        own = dict(zip(new, self.parts(new))) if new else {}
        for word, found in own.items():
            if len(word) <= LONGEST_KNOWN:
                known[word] = found
        found = [known[w] if w in known else own[w] for w in words]
        if None in found:
            return None
        return tuple(np.frombuffer(b"".join([f[k] for f in found]), dtype=np.int32).astype(np.int64) for k in (0, 1))


# ---- alignment


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One-to-one stretches (first token of either side, tokens), the irregular groups behind them (from
    and to on either side), and the links of irregular groups (tokens): arrays with a row each.

    Both arrays are of 32-bit integers, rise, start above 0 and end alike.
    """
    stretches, groups, links = [], [], []
    data_a, data_b = ends_a.astype("<i4").tobytes(), ends_b.astype("<i4").tobytes()
    at_a, at_b = memoryview(data_a).cast("i"), memoryview(data_b).cast("i")
    number, most = int.from_bytes, len(ends_a)
    i = j = 0
    while True:
        start, window = i, FIRST_WINDOW
        while True:
            one, other = data_a[4 * i : 4 * (i + window)], data_b[4 * j : 4 * (j + window)]
            if one != other:
                break
            n = len(one) >> 2
            i, j, window = i + n, j + n, 2 * window
            if i >= most:
                break
        if i < most:
            # The lowest bit that differs tells the first end that does; no end is 0, so it is found beyond the last one too.
            differs = number(one, "little") ^ number(other, "little")
            n = ((differs & -differs).bit_length() - 1) >> 5
            i, j = i + n, j + n
        if i > start:
            stretches.append((start, j - (i - start), i - start))
        if i >= most:
            break
        first, second = i, j
        while True:
            links.append((i, j))
            here, there = at_a[i], at_b[j]
            if here <= there:
                i += 1
            if there <= here:
                j += 1
            if here == there:
                break
        groups.append((first, i, second, j))
        if i >= most:
            break
    return tuple(np.array(x, dtype=np.int64).reshape(-1, n) for x, n in ((stretches, 3), (groups, 4), (links, 2)))


class Alignment:
    """Groups of one document: ``cuts_a`` and ``cuts_b`` have the first token of each, and the end."""

    def __init__(self, ids_a: np.ndarray, ids_b: np.ndarray, lengths_a: np.ndarray, lengths_b: np.ndarray):
        self.ids_a, self.ids_b = ids_a, ids_b
        stretches, groups, links = align(np.cumsum(lengths_a[ids_a]), np.cumsum(lengths_b[ids_b]))
        n = stretches[:, 2]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        one, other = (np.repeat(stretches[:, k], n) + step for k in (0, 1))
        self.cuts_a = np.concatenate([np.sort(np.concatenate([one, groups[:, 0]])), [len(ids_a)]])
        self.cuts_b = np.concatenate([np.sort(np.concatenate([other, groups[:, 2]])), [len(ids_b)]])
        self.links_a = ids_a[np.concatenate([one, links[:, 0]])]
        self.links_b = ids_b[np.concatenate([other, links[:, 1]])]

    def __len__(self) -> int:
        return len(self.cuts_a) - 1

    def in_order(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of the tokens of either side where groups are written one after the other, A before B; and which tokens end their group's side."""
        n_a, n_b = np.diff(self.cuts_a), np.diff(self.cuts_b)
        place_a = np.arange(len(self.ids_a)) + np.repeat(self.cuts_b[:-1], n_a)
        place_b = np.arange(len(self.ids_b)) + np.repeat(self.cuts_a[1:], n_b)
        return place_a, place_b, self.cuts_a[1:] - 1, self.cuts_b[1:] - 1


class Aligner:
    """Tokens of both sides and their groups; one per task."""

    def __init__(self, vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B):
        self.tokens = Tokens(vocabulary_a, vocabulary_b)
        # A token as it is written: of A with a comma or a bar, of B with a comma or a semicolon.
        sizes = [len(e) for e in self.tokens.entries]
        self.first_b = 2 * sizes[0]
        self.written = [f"{i}{mark}" for size, marks in zip(sizes, (",|", ",;")) for mark in marks for i in range(size)]
        self.sizes = sizes

    def aligned(self, text: str | None) -> Alignment | None:
        found = self.tokens.ids(text)
        return None if found is None else Alignment(*found, *self.tokens.lengths)

    def text(self, found: Alignment) -> str:
        """Groups as ``a1,a2|b1;a3|b2``."""
        place_a, place_b, last_a, last_b = found.in_order()
        code_a, code_b = found.ids_a.copy(), found.ids_b + self.first_b
        code_a[last_a] += self.sizes[0]
        code_b[last_b] += self.sizes[1]
        codes = np.empty(len(code_a) + len(code_b), dtype=np.int64)
        codes[place_a], codes[place_b] = code_a, code_b
        return "".join(map(self.written.__getitem__, codes.tolist()))[:-1]


# ---- groups per document


_GROUPS = "doc_id long, ids_a array<long>, ids_b array<long>, groups array<struct<tokens_a: long, tokens_b: long>>"


def _aligned(batches: Iterator[pa.RecordBatch], vocabulary_a: str, vocabulary_b: str) -> Iterator[pa.RecordBatch]:
    aligner = Aligner(vocabulary_a, vocabulary_b)
    kind = pa.list_(pa.struct([("tokens_a", pa.int64()), ("tokens_b", pa.int64())]))
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = aligner.aligned(text.as_py())
            ids_a, ids_b, sizes = [], [], []
            if found is not None:
                ids_a, ids_b = found.ids_a, found.ids_b
                sizes = pa.StructArray.from_arrays(
                    [pa.array(np.diff(found.cuts_a)), pa.array(np.diff(found.cuts_b))], names=["tokens_a", "tokens_b"]
                ).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([doc_id], pa.int64()),
                    pa.array([ids_a], pa.list_(pa.int64())),
                    pa.array([ids_b], pa.list_(pa.int64())),
                    pa.array([sizes], kind),
                ],
                names=["doc_id", "ids_a", "ids_b", "groups"],
            )


def align_tokens(docs: DataFrame, vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B) -> DataFrame:
    """Per document the ids of both sides and, in order, how many tokens of either a group has. No shuffle."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda b: _aligned(b, vocabulary_a, vocabulary_b), _GROUPS)


# ---- links over all documents

_ROW = pa.struct(
    [
        ("doc_id", pa.int64()),
        ("n_a", pa.int64()),
        ("n_b", pa.int64()),
        ("n_groups", pa.int64()),
        ("n_links", pa.int64()),
        ("groups_sha256", pa.string()),
        ("which", pa.binary()),
        ("times", pa.binary()),
    ]
)
_PACKET = (
    "packet long, pairs array<long>, held array<long>, rows array<struct<doc_id: long, n_a: long, n_b: long, "
    "n_groups: long, n_links: long, groups_sha256: string, which: binary, times: binary>>"
)
_PAIR_BITS = 32


def _packets(batches: Iterator[pa.RecordBatch], vocabulary_a: str, vocabulary_b: str, packet_bytes: int) -> Iterator[pa.RecordBatch]:
    aligner = Aligner(vocabulary_a, vocabulary_b)
    number, held, own, size = TaskContext.get().partitionId() << 32, [], [], 0

    def packet() -> pa.RecordBatch:
        pairs, held_by = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *(p for p, _ in own)]), return_counts=True)
        for row, (p, times) in zip(held, own):
            row["which"] = np.searchsorted(pairs, p).astype(np.int32).tobytes()
            row["times"] = times.astype(np.int32).tobytes()
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number]),
                pa.array([pairs], pa.list_(pa.int64())),
                pa.array([held_by], pa.list_(pa.int64())),
                pa.array([held], pa.list_(_ROW)),
            ],
            names=["packet", "pairs", "held", "rows"],
        )

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            row = {"doc_id": doc_id, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": ""}
            pairs = times = np.zeros(0, dtype=np.int64)
            if (found := aligner.aligned(text)) is not None:
                pairs, times = np.unique(found.links_a << _PAIR_BITS | found.links_b, return_counts=True)
                row |= {"n_a": len(found.ids_a), "n_b": len(found.ids_b), "n_groups": len(found), "n_links": len(found.links_a)}
                row["groups_sha256"] = hashlib.sha256(aligner.text(found).encode()).hexdigest()
            held.append(row)
            own.append((pairs, times))
            size += len(text or "")
            if size >= packet_bytes:
                yield packet()
                number, held, own, size = number + 1, [], [], 0
    if held:
        yield packet()


def pair_counts(packets: DataFrame) -> DataFrame:
    """``pair``, in how many documents it is linked, and whether no pair of its A id is in more."""
    counts = saved(packets.select(F.explode(F.arrays_zip("pairs", "held")).alias("p")).groupBy("p.pairs").agg(F.sum("p.held").alias("count")))
    side = F.shiftright("pairs", _PAIR_BITS)
    # An A id has as many pairs as the other vocabulary has ids at most.
    best = saved(counts.groupBy(side.alias("a")).agg(F.max("count").alias("most")))
    return saved(
        counts.withColumn("a", side).join(best, "a").select(F.col("pairs").alias("pair"), "count", (F.col("count") == F.col("most")).alias("best"))
    )


STATISTICS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _judged(packets: pa.Table, answers: pa.Table) -> pa.Table:
    """Documents of one packet with the counts of their links."""
    order = np.argsort(answers.column("pair").to_numpy())
    count, best = (answers.column(c).to_numpy()[order].astype(np.int64) for c in ("count", "best"))
    found: dict[str, list] = {f.split()[0]: [] for f in STATISTICS.split(", ")}
    for rows in packets.column("rows").to_pylist():
        for row in rows:
            which, times = (np.frombuffer(row[c], dtype=np.int32) for c in ("which", "times"))
            row["n_best"], row["count_sum"] = int((times * best[which]).sum()), int((times * count[which]).sum())
            for name, values in found.items():
                values.append(row[name])
    return pa.table({n: pa.array(v, pa.string() if n == "groups_sha256" else pa.int64()) for n, v in found.items()})


def link_statistics(
    docs: DataFrame, vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B, packet_bytes: int = PACKET_BYTES
) -> DataFrame:
    """A row per document: tokens, groups, links, links at their A id's best count, sum of counts, digest of the groups."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    packets = saved(rows.mapInArrow(lambda b: _packets(b, vocabulary_a, vocabulary_b, packet_bytes), _PACKET))
    answers = packets.select(F.col("packet").alias("asker"), F.explode("pairs").alias("pair")).join(pair_counts(packets), "pair")
    return (
        packets.select("packet", "rows")
        .groupBy("packet")
        .cogroup(answers.groupBy("asker"))
        .applyInArrow(_judged, STATISTICS)
    )


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_statistics(read_table(spark, sf_dir, "documents"))
