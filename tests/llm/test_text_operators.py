"""Substring, line and exact dedup against plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from holdfast.llm import exact_dedup, line_dedup, substring_dedup
from tests.llm.helpers import EDGES, documents

BLANKS = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def split_words(text):
    for b in BLANKS[1:]:
        text = text.replace(b, " ")
    return [w for w in text.split(" ") if w]


def brute_repeats(rows, length):
    words = [split_words(t or "") for _, t in rows]
    counts = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    found = []
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if counts[tuple(w[k : k + length])] > 1:
                gone[k : k + length] = [True] * length
        found.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(found, key=repr)


def repeats(df, **options):
    rows = substring_dedup.remove_repeats(df, **options).collect()
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows), key=repr)


@pytest.mark.parametrize("clashing", [False, True])
def test_substring_edges(spark, clashing):
    assert repeats(documents(spark, EDGES, clashing)) == brute_repeats(EDGES, 35)
    assert repeats(documents(spark, EDGES).limit(0)) == []


@pytest.mark.parametrize("seed", range(4))
def test_substring_random(spark, seed):
    """Few words, so that repeats overlap, repeat inside a document and have periods."""
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("ab" if seed % 2 else "abcdefgh") for _ in range(rng.randint(1, 30))) for _ in range(6)]
    rows = [(k, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 6)))) for k in range(40)]
    assert repeats(documents(spark, rows), length=9, seed=3) == brute_repeats(rows, 9)


def test_maximal_repeats(spark):
    shared = [f"s{i}" for i in range(40)]
    rows = [(1, " ".join(["x"] * 3 + shared + ["y"])), (2, " ".join(shared + ["z"] * 4)), (3, "short")]
    found = {(r.doc_id, r.first_word, r.last_word) for r in substring_dedup.maximal_repeats(documents(spark, rows)).collect()}
    assert found == {(1, 3, 42), (2, 0, 39)}


def test_sliding_minimum():
    values = np.array([5, 3, 9, 1, 7, 7, 2, 8], dtype=np.uint64)
    for size in range(1, 9):
        assert substring_dedup.sliding_min(values, size).tolist() == [values[i : i + size].min() for i in range(9 - size)]


def brute_lines(rows, least):
    def keys(text):
        return [lower(line.strip(BLANKS)) for line in (text or "").split("\n")]

    counts = Counter(k for _, t in rows for k in set(keys(t)) if k)
    found = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, keys(t)) if not (k and counts[k] >= least)]
        found.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(found, key=repr)


def lines(df, least):
    rows = line_dedup.drop_common_lines(df, least).collect()
    return sorted(((r.row["doc_id"], r.n_lines, r.n_dropped, r.kept) for r in rows), key=repr)


@pytest.mark.parametrize("clashing", [False, True])
def test_line_edges(spark, clashing):
    rows = EDGES + [(100 + k, f"  Head\x0b\nbody {k}\nhead") for k in range(3)]
    assert lines(documents(spark, rows, clashing), 3) == brute_lines(rows, 3)
    assert lines(documents(spark, rows).limit(0), 3) == []


@pytest.mark.parametrize("names", [1, 7, 50])
def test_shards_with_a_common_line_are_split(spark, monkeypatch, names):
    rows = [(i, f"everywhere\nline {i % 9}\nown {i}\n{'twice' if i < 2 else 'x' * i}") for i in range(60)]
    monkeypatch.setattr(line_dedup, "HOT_NAMES", names)
    monkeypatch.setattr(line_dedup, "LEAST_SHARDS", 3)
    packets = line_dedup.packets_of(line_dedup.keyed(documents(spark, rows).repartition(8)))
    hot = {r.shard: r.parts for r in line_dedup.hot_shards(packets, 3).collect()}
    assert hot and min(hot.values()) > 1
    for least in (2, 7, 60, 61):
        assert lines(documents(spark, rows).repartition(8), least) == brute_lines(rows, least)


def test_lines_gone_from_texts(spark):
    rows = [(k, f"Top\nown {k}\n top ") for k in range(10)] + [(10, None)]
    found = line_dedup.without_common_lines(documents(spark, rows))
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {(r.doc_id, r.text, r.n_chars) for r in found.collect()} == {(k, f"own {k}", 5) for k in range(10)} | {(10, "", 0)}


def test_perfect_hash_gives_every_name_its_slot():
    rng = np.random.default_rng(2)
    first, second = (rng.integers(0, 1 << 63, 5000).astype(np.uint64) for _ in range(2))
    first[:10] = first[0]  # equal halves
    sizes, bits = line_dedup.build_hash(first, second)
    assert sorted(line_dedup.find_slots(sizes, bits, first, second)) == list(range(5000))
    assert bits.sum() == 5000
    assert line_dedup.build_hash(first[:0], second[:0])[0] == []


def brute_groups(rows):
    texts = [lower(t or "") for _, t in rows]
    ids: dict[str, list] = {}
    for (i, _), t in zip(rows, texts):
        ids.setdefault(t, []).append(i)
    found = []
    for (i, _), t in zip(rows, texts):
        keep = max((x for x in ids[t] if x is not None), default=None)
        found.append((i, keep, len(ids[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(found, key=repr)


def groups(df, size):
    rows = exact_dedup.exact_groups(df, size).collect()
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows), key=repr)


@pytest.mark.parametrize("size, clashing", [(4096, False), (7, True)])
def test_exact_edges(spark, size, clashing):
    rows = EDGES if size > 100 else [r for r in EDGES if len(r[1] or "") < 1000]
    rows = rows + [(20, "abcdefg" * 5), (21, "ABCDEFG" * 5), (22, "abcdefg" * 6), (23, "abcdefg" * 4 + "x")]
    assert groups(documents(spark, rows, clashing), size) == brute_groups(rows)
    assert groups(documents(spark, rows).limit(0), size) == []


def test_blocks_whose_hashes_agree_keep_their_own_names(spark, monkeypatch):
    """With one hash for all blocks, only their contents tell them apart."""
    from pyspark.sql import functions as F

    rows = [(k, t) for k, t in enumerate(["aaaa", "bbbb", "aaaabbbb", "bbbbaaaa", "aaaabbbb", "AAAA"])]
    real = F.xxhash64
    expected = brute_groups(rows)
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda c: real(c) * 0)
    rows_df = documents(spark, rows)
    from holdfast.llm import tables

    monkeypatch.setattr(tables.F, "xxhash64", lambda *c: real(*c) if len(c) > 1 else real(*c) * 0)
    assert groups(rows_df, 4) == expected
