"""Documents that contain benchmark items (operator 6).

Greedy string tiling. Words are runs of letters and digits, lower-cased in ASCII, so punctuation and
layout do not hide a passage. Documents and items that share a seed, ``SHORTEST`` consecutive words,
are candidates. A candidate is tiled by running Karp-Rabin: for a search length that falls from
long to ``SHORTEST``, rolling hashes find equal unmarked stretches, matches are extended as far as
both sides agree and are unmarked, and the longest are marked first, so tiles never overlap and an
item whose passages were reordered is still covered. An item is found when tiles cover at least
``COVERAGE`` of its words. Of an item under ``WHOLE`` words a common phrase would cover that much, so
it is found only as a whole, in one tile, however short it is.

The benchmark is a stated query set. It is taken in blocks of ``BLOCK_BYTES`` of text at most (an item
is not split), and one block at a time is sent to the tasks; every document is held against every
block, whole. Nothing of the documents is shuffled, whatever their sources or copies.

Defined results: null and empty texts have no words, and items without words are never found; items
with equal texts are sought once and all reported, as are items with a null id; repeated rows give a
row each; null document ids stay null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.tables import KEYS, fresh, keyed, read_table, row_keys
from holdfast.llm.words import MARKS, Namer, Words, slices

# Tiles of four words hold most of a passage even if all of its sentences change places.
SHORTEST = 4
COVERAGE = 0.6
# Items of fewer words are found whole only.
WHOLE = 10
LONGEST_SEARCH = 40
BLOCK_BYTES = 4 << 20

RESULT = (
    "row_id long, row_text long, doc_id long, item_id long, coverage double, "
    "tiles array<struct<item_word: long, doc_word: long, words: long>>"
)

# ---- tiling


def _rolling(names: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all stretches of ``size`` words."""
    count = len(names) - size + 1
    hashes = np.zeros(max(0, count), dtype=np.uint64)
    for k in range(size if count > 0 else 0):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C17) + names[k : k + count]
    return hashes


def _unmarked(marked: np.ndarray, size: int) -> np.ndarray:
    """Starts of stretches of ``size`` words none of which is marked."""
    sums = np.concatenate(([0], np.cumsum(marked)))
    return np.flatnonzero(sums[size:] == sums[:-size]) if len(marked) >= size else np.zeros(0, dtype=np.int64)


def tile(item: np.ndarray, text: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """Non-overlapping equal stretches, longest first: place in item, place in text, words."""
    item_marked, text_marked = np.zeros(len(item), dtype=bool), np.zeros(len(text), dtype=bool)
    tiles: list[tuple[int, int, int]] = []
    search = max(shortest, min(LONGEST_SEARCH, len(item)))
    while not item_marked.all():
        mine, theirs = _unmarked(item_marked, search), _unmarked(text_marked, search)
        own = _rolling(item, search)[mine]
        found = _rolling(text, search)[theirs]
        found, theirs = found[(keep := np.isin(found, own))], theirs[keep]
        places: dict[int, list[int]] = {}
        for place, value in zip(mine.tolist(), own.tolist()):
            places.setdefault(value, []).append(place)
        matches = []
        for start, value in zip(theirs.tolist(), found.tolist()):
            for place in places[value]:
                if place and start and item[place - 1] == text[start - 1] and not item_marked[place - 1] and not text_marked[start - 1]:
                    continue  # part of the match that starts a word before
                room = min(len(item) - place, len(text) - start)
                differs = (item[place : place + room] != text[start : start + room]) | item_marked[place : place + room] | text_marked[start : start + room]
                words = int(differs.argmax()) if differs.any() else room
                if words >= search:
                    matches.append((words, place, start))
        for words, place, start in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if not item_marked[place : place + words].any() and not text_marked[start : start + words].any():
                item_marked[place : place + words] = text_marked[start : start + words] = True
                tiles.append((place, start, words))
        if search == shortest:
            # A match cut by a longer tile may leave a stretch that still is long enough.
            if not matches:
                break
        else:
            search = max(shortest, search // 2)
    return tiles


# ---- candidates


def block_arrays(items: list[tuple[list, str]], shortest: int) -> tuple:
    """Ids and words of the items; their sorted seeds by length: name, item and place in the item.

    Seeds have ``shortest`` words, those of shorter items all of the item's words.
    """
    words = Namer(MARKS, lower=True).words([t.encode() for _, t in items])
    sizes, document = np.diff(words.firsts), words.documents()
    seeds = {}
    for size in range(1, shortest + 1):
        names = words.grams(size)
        inside = np.flatnonzero(np.arange(len(names)) + size <= words.last()[: len(names)])
        if size < shortest:
            inside = inside[sizes[document[inside]] == size]
        inside = inside[np.argsort(names[inside], kind="stable")]
        if len(inside):
            item = document[inside]
            seeds[size] = names[inside], item, inside - words.firsts[item]
    return [i for i, _ in items], [words.names[a:b] for a, b in zip(words.firsts, words.firsts[1:])], seeds


def seed_hits(words: Words, seeds: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place in the words, item, place in the item and length of every seed that a slice shares with the items."""
    found = [np.zeros((4, 0), dtype=np.int64)]
    for size, (known, known_item, known_place) in seeds.items():
        names = words.grams(size)
        if not len(names):
            continue
        low = np.searchsorted(known, names)
        hit = known[np.minimum(low, len(known) - 1)] == names
        hit &= np.arange(len(names)) + size <= words.last()[: len(names)]
        at = np.flatnonzero(hit)
        low = low[at]
        count = np.searchsorted(known, names[at], side="right") - low
        each = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        found.append(np.stack([np.repeat(at, count), known_item[each], known_place[each], np.full(len(each), size)]))
    return tuple(np.concatenate(found, axis=1))


def _found(batches: Iterator[pa.RecordBatch], block: tuple, shortest: int, coverage: float) -> Iterator[pa.RecordBatch]:
    namer = Namer(MARKS, lower=True)
    item_ids, items, known = block
    for batch, texts in slices(batches):
        words = namer.words(texts)
        place, item, item_place, size = seed_hits(words, known)
        if not len(place):
            continue
        pair = words.documents()[place] * len(items) + item
        order = np.argsort(pair, kind="stable")
        cuts = np.flatnonzero(np.diff(pair[order])) + 1
        rows, ids, shares, tiles = [], [], [], []
        for own in np.split(order, cuts):
            document, which = divmod(int(pair[own[0]]), len(items))
            target = items[which]
            first, last = words.firsts[document], words.firsts[document + 1]
            if len(target) < shortest:
                found = [(0, int(place[own[0]] - first), len(target))]
            else:
                # No tiling covers more than all seeds together.
                reach = np.zeros(len(target) + 1, dtype=np.int64)
                inner = np.unique(item_place[own])
                np.add.at(reach, inner, 1)
                np.add.at(reach, inner + shortest, -1)
                if (np.cumsum(reach)[:-1] > 0).sum() < coverage * len(target):
                    continue
                found = tile(target, words.names[first:last], shortest)
            share = sum(t[2] for t in found) / len(target)
            if found[0][2] == len(target) if found and len(target) < WHOLE else share >= coverage:
                for item_id in item_ids[which]:
                    rows.append(document)
                    ids.append(item_id)
                    shares.append(share)
                    tiles.append([{"item_word": a, "doc_word": b, "words": n} for a, b, n in found])
        if rows:
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i).take(pa.array(rows)) for i in range(3)),
                    pa.array(ids, pa.int64()),
                    pa.array(shares, pa.float64()),
                    pa.array(
                        tiles,
                        pa.list_(pa.struct([("item_word", pa.int64()), ("doc_word", pa.int64()), ("words", pa.int64())])),
                    ),
                ],
                names=[*KEYS, "doc_id", "item_id", "coverage", "tiles"],
            )


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[list, str]]]:
    """Items in blocks of about ``block_bytes`` of text, and all ids of each. One block at a time is on the driver."""
    item_id = F.struct(F.col("item_id").cast("long").alias("id"))
    items = (
        benchmark.select(item_id.alias("item"), F.coalesce("text", F.lit("")).alias("text"))
        .filter("text != ''")
        .groupBy("text")
        .agg(F.sort_array(F.collect_list("item")).alias("items"))
    )
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    for k in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k)
        yield sorted((([i["id"] for i in r["items"]], r["text"]) for r in own.collect()), key=lambda r: r[1])


def contaminated(
    docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, shortest: int = SHORTEST, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """A row per document and item found in it: row key, ``doc_id``, ``item_id``, ``coverage``, ``tiles``."""
    spark = docs.sparkSession
    rows = keyed(docs).select(*KEYS, "doc_id", "text")
    found = spark.createDataFrame([], RESULT)
    for items in benchmark_blocks(benchmark, block_bytes):
        block = spark.sparkContext.broadcast(block_arrays(items, shortest))
        part = rows.mapInArrow(
            lambda batches, block=block: _found(batches, block.value, shortest, coverage), RESULT
        )
        found = found.unionByName(part)
    return found


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` less the documents in which an item was found."""
    names = [fresh(docs, k) for k in KEYS]
    keys = row_keys()
    found = contaminated(docs, benchmark).select(*(F.col(k).alias(n) for k, n in zip(KEYS, names))).distinct()
    return docs.withColumns(dict(zip(names, keys))).join(found, names, "left_anti").drop(*names)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", F.size("tiles").cast("long").alias("n_tiles"))
