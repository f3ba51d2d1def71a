import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from holdfast.llm import packing
from tests.conftest import SF_DIR
from tests.llm.helpers import EDGES, documents


@pytest.fixture(scope="module")
def exact():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(pieces, docs, exact, size=2048):
    """Every id lies in one piece and sequences are gapless; returns the share of padding."""
    ids = sorted((exact.encode(t or "", add_special_tokens=False).ids + [1] for _, t in docs), key=repr)
    by_sequence = defaultdict(list)
    for p in pieces:
        assert p.length > 0 and len(p.ids) == 4 * p.length
        by_sequence[p.sequence_id].append(p)
    used = padding = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
        used += at
        padding += 0 if at & (at - 1) == 0 else size - at
    texts, text, expected_start = [], [], 0
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.start == expected_start
        text += np.frombuffer(p.ids, dtype="<u4").tolist()
        expected_start += p.length
        if expected_start == p.doc_tokens:
            texts.append(text)
            text, expected_start = [], 0
    assert not text and sorted(texts, key=repr) == ids
    return padding / max(1, used)


def test_all_documents(spark, exact):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    share = check(packing.pack(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()], exact)
    assert share < 0.03


@pytest.mark.parametrize("clashing", [False, True])
def test_edges(spark, exact, clashing):
    check(packing.pack(documents(spark, EDGES, clashing)).collect(), EDGES, exact)
    assert packing.pack(documents(spark, EDGES).limit(0)).collect() == []


def test_texts_longer_than_a_chunk(spark, exact, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 5000)
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(["alpha", "beta.", "x", "Gamma\n"]) for _ in range(n))) for k, n in enumerate([9000, 3, 0, 500, 20_000, 1])]
    pieces = packing.pack(documents(spark, rows).coalesce(1)).collect()
    assert check(pieces, rows, exact) < 0.03


def brute_cost(points, penalties, size):
    best = {points[0]: 0}
    for i in range(1, len(points)):
        here = points[i]
        costs = []
        for j in range(i):
            length = here - points[j]
            if length <= size:
                free = length & (length - 1) == 0 and length >= packing.LEAST_POWER
                costs.append(best[points[j]] + (0 if free else size - length))
        best[here] = min(costs) + penalties[i]
    return best[points[-1]]


@pytest.mark.parametrize("seed", range(5))
def test_cuts_are_optimal(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 300, 60).tolist()
    points, penalties = packing.cut_points(lengths, rng.random(sum(lengths)) < 0.03)
    cuts = packing.best_cuts(points, penalties, 512)
    penalty = dict(zip(points.tolist(), penalties.tolist()))
    cost = sum(
        penalty[b] + (0 if (b - a) & (b - a - 1) == 0 and b - a >= packing.LEAST_POWER else 512 - (b - a))
        for a, b in zip(cuts, cuts[1:])
    )
    assert cuts[0] == 0 and cuts[-1] == sum(lengths) and max(np.diff(cuts)) <= 512
    assert cost == brute_cost(points.tolist(), penalties.tolist(), 512)


def test_ids_are_those_of_the_reference_library(exact, monkeypatch):
    encoder = packing.Encoder("byte_bpe_50k")
    rng = random.Random(1)
    plain = [chr(c) for c in (9, 10, 13, *range(32, 127), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x180))]
    odd = [*"  \u0085​٣五😀ªº×÷\x0b\x0c\x00", "<|endoftext|>", " "]
    for k in range(3000):
        alphabet = plain if k % 3 else plain[:60] + odd
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80)))
        assert encoder.ids(text).tolist() == exact.encode(text, add_special_tokens=False).ids + [1]
    monkeypatch.setattr(packing, "LONG_TEXT", 50)
    text = " ".join(rng.choice(["it's", "don't", "a", "b  c", "x\n", "Über", "7"]) for _ in range(500))
    assert encoder.ids(text).tolist() == exact.encode(text, add_special_tokens=False).ids + [1]


def test_query_digest(spark):
    rows = packing.op10_packing(spark, SF_DIR).limit(20).collect()
    pieces = {(p.doc_id, p.start): p for p in packing.pack(spark.read.parquet(f"{SF_DIR}/documents.parquet")).collect()}
    assert all(r.ids_crc32 == zlib.crc32(pieces[r.doc_id, r.start].ids) for r in rows)


def test_size_is_a_power_of_two(spark):
    with pytest.raises(ValueError):
        packing.pack(documents(spark, EDGES), size=1000)
