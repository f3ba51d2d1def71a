import re

import numpy as np
import pytest

from holdfast.llm import decontaminate as d
from tests.conftest import SF_DIR
from tests.llm.helpers import EDGES, documents


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))


def brute_tiles(item, text, shortest):
    """Greedy string tiling as defined: mark the longest match between unmarked words, again and again."""
    item_marked, text_marked, tiles = [False] * len(item), [False] * len(text), []
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for t in range(len(text)):
                k = 0
                while (
                    p + k < len(item) and t + k < len(text) and item[p + k] == text[t + k]
                    and not item_marked[p + k] and not text_marked[t + k]
                ):
                    k += 1
                best = max(best, (k, -p, -t))
        if best[0] < shortest:
            return tiles
        k, p, t = best[0], -best[1], -best[2]
        item_marked[p : p + k] = text_marked[t : t + k] = [True] * k
        tiles.append((p, t, k))


@pytest.mark.parametrize("seed", range(30))
def test_tiles_cover_as_much_as_the_definition(seed):
    rng = np.random.default_rng(seed)
    item = rng.integers(0, 6, 30).astype(np.uint64)
    text = np.concatenate([rng.integers(0, 6, 20), item[15:], rng.integers(0, 6, 9), item[:15]]).astype(np.uint64)
    found, expected = d.tile(item, text, 5), brute_tiles(item.tolist(), text.tolist(), 5)
    assert sum(t[2] for t in found) == sum(t[2] for t in expected)
    used_item, used_text = set(), set()
    for p, t, k in found:
        assert k >= 5 and (item[p : p + k] == text[t : t + k]).all()
        assert not used_item & set(range(p, p + k)) and not used_text & set(range(t, t + k))
        used_item |= set(range(p, p + k))
        used_text |= set(range(t, t + k))


def found(docs, items, **options):
    rows = d.contaminated(docs, items, **options).collect()
    return sorted(((r.doc_id, r.item_id, round(r.coverage, 9)) for r in rows), key=repr)


def test_all_documents_against_the_definition(spark):
    docs, items = (spark.read.parquet(f"{SF_DIR}/{n}.parquet") for n in ("documents", "benchmark"))
    expected = []
    all_items = [(r.item_id, words(r.text)) for r in items.collect()]
    for r in docs.collect():
        own = words(r.text)
        n = d.SHORTEST
        grams = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
        for item_id, item in all_items:
            if sum(tuple(item[i : i + n]) in grams for i in range(len(item) - n + 1)) > len(item) / 4:
                share = sum(t[2] for t in brute_tiles(item, own, n)) / len(item)
                if share >= d.COVERAGE:
                    expected.append((r.doc_id, item_id, round(share, 9)))
    assert expected and found(docs, items) == sorted(expected, key=repr)
    assert found(docs, items, block_bytes=300) == sorted(expected, key=repr)


def test_reordered_and_disguised_passages(spark):
    item = [f"q{i}" for i in range(40)]
    rows = EDGES + [
        (50, "before " + " ".join(item[20:]) + ". And, " + " ".join(item[:20]).upper()),
        (51, ", ".join(item)),
        (52, " ".join(item[:23])),
        (53, " ".join(item[:24])),
        (54, " ".join(reversed(item))),
        (None, " ".join(item)),
        (51, ", ".join(item)),
    ]
    items = spark.createDataFrame([(7, " ".join(item)), (9, " ".join(item)), (8, "q1 q2"), (None, None), (3, "")], "item_id long, text string")
    docs = documents(spark, rows, clashing=True)
    # Items 7 and 9 have one text; item 8 is two words that are together in each of these.
    whole = [(i, j, 1.0) for i in (50, 51, 51, None) for j in (7, 9)] + [(53, 7, 0.6), (53, 9, 0.6)]
    assert found(docs, items) == sorted(whole + [(i, 8, 1.0) for i in (50, 51, 51, 52, 53, None)], key=repr)
    kept = d.without_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 6
    assert found(docs, items.limit(0)) == [] and found(docs.limit(0), items) == []


def test_shuffled_sentences_are_found(spark):
    """Items whose sentences all change places, inside other text."""
    import random

    rng = random.Random(6)
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    rows = []
    for r in items.collect():
        sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n", r.text) if s]
        rng.shuffle(sentences)
        rows.append((r.item_id, "Other words come first. " + " ".join(sentences) + "\nAnd some follow."))
    assert {(i, j) for i, j, _ in found(documents(spark, rows), items) if i == j} == {(i, i) for i, _ in rows}


def test_short_items_are_found_whole_only(spark):
    items = [(1, "blue whale song"), (2, "what is the capital of peru"), (3, "Yes!"), (4, "one two three four five six seven eight nine"), (5, None)]
    docs = [
        (10, "the Blue, whale song was heard"), (11, "blue whale"), (12, "what is the capital gain tax here"),
        (13, "So: what is the capital of Peru?"), (14, "yes"), (15, "yesterday"), (16, "one two three four five six seven eight"),
        (17, "zero one two three four five six seven eight nine ten"), (18, "song blue whale"), (19, "five six seven eight nine one two three four"),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    expected = sorted([(10, 1, 1.0), (13, 2, 1.0), (14, 3, 1.0), (17, 4, 1.0)], key=repr)
    assert found(documents(spark, docs), benchmark) == expected
    assert found(documents(spark, docs), benchmark, block_bytes=20) == expected
