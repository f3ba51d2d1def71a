"""SimHash fingerprints and links between close ones by anchor points (operator 8).

Anchor-point covering. The two 32-bit halves of a fingerprint are taken apart: of ``t`` differing bits
one half has at most ``t // 2``. 31 bits of a half are covered by the Hamming code [31, 26], whose
words are the anchors: every value lies within radius 1 of exactly one, its home. A value is replicated
to all anchors within radius plus threshold; so of two close values, each is at the other's home.
Values are compared per anchor only, on all 64 bits.

There are 2^26 anchors for each half, so groups stay small until billions of fingerprints. A group
gives a spanning tree of its links, never all its pairs; a large group is first split by thirds of the
fingerprint (of which one agrees), so its work stays bounded as well. Components of the trees are those
of all links.

Defined results: a null or empty text has fingerprint zero and is linked like any other; equal
fingerprints are one node however many rows have it; null ids stay null and never name a component,
unless all of its ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.components import components
from holdfast.llm.tables import KEYS, fresh, keyed, read_table, row_keys, saved
from holdfast.llm.words import encoded

SHINGLE = 3
SEED = 42
THRESHOLD = 2
# Groups up to this size compare all pairs; beyond the second, thirds of the fingerprint split them first.
SMALL_GROUP, LARGE_GROUP = 32, 20_000
_CHUNK = 1 << 16

# ---- fingerprints


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """Space-joined runs of ``size`` words, repeats included; of fewer words, the whole sequence."""
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)))))


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), _CHUNK):
        part = hashes[start : start + _CHUNK].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    found = shingles(text.lower().split(), size)
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(s, SEED) for s in found), dtype=np.uint64, count=len(found))) if found else 0


def _fingerprints(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        *others, texts = batch.columns
        values = np.array([fingerprint(t, size) for t in encoded(texts)], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([*others, pa.array(values.view(np.int64))], names=[*batch.schema.names[:-1], "code"])


# ---- anchors


def _hamming_tables() -> tuple[list[int], np.ndarray]:
    """Masks of the five checks, and for every syndrome the flips that lead to an anchor: home first."""
    masks = [sum(1 << (place - 1) for place in range(1, 32) if place >> b & 1) for b in range(5)]
    flips = np.zeros((32, 16), dtype=np.int64)
    for syndrome in range(1, 32):
        flips[syndrome, 0] = 1 << (syndrome - 1)
        pairs = [(p, p ^ syndrome) for p in range(1, 32) if p < p ^ syndrome and p != syndrome and p ^ syndrome != 0]
        flips[syndrome, 1:] = [1 << (p - 1) | 1 << (q - 1) for p, q in pairs]
    return masks, flips


def anchors(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of 31-bit values: index of the value, anchor, and the bits between them; all anchors within distance 2."""
    masks, flips = _hamming_tables()
    syndrome = np.zeros(len(values), dtype=np.int64)
    for b, mask in enumerate(masks):
        syndrome |= (np.bitwise_count(values & mask) & 1).astype(np.int64) << b
    bits = flips[syndrome]
    words = values[:, None] ^ bits
    valid = np.ones(words.shape, dtype=bool)
    valid[syndrome == 0, 1:] = False
    which = np.repeat(np.arange(len(values)), 16).reshape(words.shape)
    return which[valid], words[valid], bits[valid]


def at_home(bits: np.ndarray) -> np.ndarray:
    """Whether a value is at its home: no other anchor is within radius 1."""
    return np.bitwise_count(bits) <= 1


def replicate(parts: list[np.ndarray], nodes: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
    """Rows of all anchors of all 31-bit parts."""
    found = [anchors(p) for p in parts]
    which = np.concatenate([f[0] for f in found])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([f[1] | np.int64(k) << 31 for k, f in enumerate(found)])),
            pa.array(nodes[which]),
            pa.array(codes[which]),
            pa.array(np.concatenate([f[2] for f in found]).astype(np.int32)),
        ],
        names=["anchor", "node", "code", "bits"],
    )


REPLICA = "anchor long, node long, code long, bits int"


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = batch.column(0).to_numpy()
        low = np.int64((1 << 31) - 1)
        yield replicate([codes & low, (codes >> 32) & low], codes, codes)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64))


def tree_links(nodes: np.ndarray, codes: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in one group; a node is compared with those not reached yet."""
    left, right = [], []
    rest = np.arange(len(nodes))
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            at = todo.pop()
            near = _distance(codes[rest], codes[at : at + 1]) <= threshold
            reached, rest = rest[near], rest[~near]
            left.append(np.full(len(reached), nodes[at]))
            right.append(nodes[reached])
            todo.extend(reached.tolist())
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def group_links(nodes: np.ndarray, codes: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    if len(nodes) <= LARGE_GROUP or threshold > 2:
        return tree_links(nodes, codes, threshold)
    found = []
    for shift, bits in ((0, 22), (22, 21), (43, 21)):
        part = (codes.view(np.uint64) >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order])) + 1
        found += [tree_links(nodes[o], codes[o], threshold) for o in np.split(order, cuts) if len(o) > 1]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def whole_group(nodes, codes, bits, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a large group, whatever lies between its nodes and the anchor."""
    return group_links(nodes, codes, threshold)


def compared(batches: Iterator[pa.RecordBatch], threshold: int, large=whole_group) -> Iterator[pa.RecordBatch]:
    """Links of rows sorted by anchor. Each side of a link found in a small group is at the other's home."""

    def links(anchor, node, code, bits):
        home = at_home(bits)
        starts = np.concatenate(([0], np.flatnonzero(np.diff(anchor)) + 1, [len(anchor)]))
        sizes = np.diff(starts)
        left, right = [], []
        small = np.repeat(sizes <= SMALL_GROUP, sizes)
        for shift in range(1, min(int(sizes.max()), SMALL_GROUP)):
            same = np.flatnonzero((anchor[shift:] == anchor[:-shift]) & small[shift:])
            if not len(same):
                break
            same = same[(home[same] | home[same + shift]) & (node[same] != node[same + shift])]
            same = same[_distance(code[same], code[same + shift]) <= threshold]
            left.append(node[same])
            right.append(node[same + shift])
        for g in np.flatnonzero(sizes > SMALL_GROUP):
            own = slice(starts[g], starts[g + 1])
            a, b = large(node[own], code[own], bits[own], threshold)
            left.append(a)
            right.append(b)
        if not left:
            return None
        pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if held and held[-1][0][-1] == columns[0][0] == columns[0][-1]:
            held.append(columns)  # one group goes on
            continue
        joined = [np.concatenate(c) for c in zip(*held, columns)]
        cut = int(np.searchsorted(joined[0], joined[0][-1]))
        held = [[c[cut:] for c in joined]]
        if cut and (found := links(*(c[:cut] for c in joined))):
            yield found
    if held and (found := links(*(np.concatenate(c) for c in zip(*held)))):
        yield found


def anchor_links(replicas: DataFrame, threshold: int, large=whole_group) -> DataFrame:
    """Links ``a``, ``b`` between nodes that meet at an anchor and differ in at most ``threshold`` bits."""
    return (
        replicas.repartition("anchor")
        .sortWithinPartitions("anchor", "node")
        .mapInArrow(lambda batches: compared(batches, threshold, large), "a long, b long")
    )


def fingerprint_components(codes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``node``, ``root`` for fingerprints that are not the least of their component. ``codes``: distinct ``code``."""
    if not 0 <= threshold <= 3:
        raise ValueError("halves of the fingerprint are covered for thresholds up to 3")
    replicas = codes.select("code").mapInArrow(_halves, REPLICA)
    return components(anchor_links(replicas, threshold))


def simhash_classes(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, a row per document."""
    prints = saved(
        keyed(docs).select("doc_id", "text").mapInArrow(lambda b: _fingerprints(b, size), "doc_id long, code long")
    )
    codes = saved(prints.groupBy("code").agg(F.min("doc_id").alias("least")))
    roots = codes.join(fingerprint_components(codes, threshold), F.col("code") == F.col("node"), "left").select(
        "code", "least", F.coalesce("root", "code").alias("root")
    )
    names = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = saved(roots.select("code", "root").join(names, "root").select("code", "component_id"))
    return prints.join(named, "code").select(
        "doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id"
    )


def without_near_copies(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each component: that of the least id, null ids last.

    Rows with equal id and equal text are one document.
    """
    names = [fresh(docs, k) for k in KEYS]
    renamed = [F.col(k).alias(n) for k, n in zip(KEYS, names)]
    prints = saved(
        keyed(docs)
        .select(*KEYS, "doc_id", "text")
        .mapInArrow(lambda b: _fingerprints(b, size), "row_id long, row_text long, doc_id long, code long")
    )
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_text", "row_id")
    codes = saved(prints.groupBy("code").agg(F.min(order).alias("least")))
    roots = saved(
        codes.join(fingerprint_components(codes, threshold), F.col("code") == F.col("node"), "left").select(
            "code", "least", F.coalesce("root", "code").alias("root")
        )
    )
    stay = saved(roots.join(roots.groupBy("root").agg(F.min("least").alias("stay")), "root").select("code", "stay"))
    stays = (F.col("row_id") == F.col("stay.row_id")) & (F.col("row_text") == F.col("stay.row_text"))
    found = saved(prints.join(stay, "code").select(*KEYS, stays.alias("stays")))
    gone = found.filter("NOT stays").select(*renamed).distinct()
    repeated = found.filter("stays").groupBy(*KEYS).count().filter("count > 1").select(*renamed)
    kept = saved(docs.withColumns(dict(zip(names, row_keys()))).join(gone, names, "left_anti"))
    once = kept.join(repeated, names, "left_anti")
    first = kept.join(repeated, names, "left_semi").dropDuplicates(names)
    return once.unionByName(first).drop(*names)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(read_table(spark, sf_dir, "documents"))
