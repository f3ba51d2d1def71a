import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from holdfast.llm import token_alignment as ta
from tests.conftest import SF_DIR
from tests.llm.helpers import EDGES, documents


@pytest.fixture(scope="module")
def both():
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    exact.encode_special_tokens = True
    return exact, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_letters():
    """The characters that stand for bytes in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def brute(rows, both):
    """All pairs of overlapping ranges, by their definition."""
    exact, pieces = both
    letters, per_row, counts = byte_letters(), [], Counter()
    for i, text in rows:
        a = exact.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in exact.id_to_token(t)) for t in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if pieces.is_byte(t) else p.replace("▁", " ").encode() for t in b for p in [pieces.id_to_piece(t)]]
        data = b" " + (text or "").encode()
        if not text or b"".join(bytes_a) != data or b"".join(bytes_b) != data:
            per_row.append((i, [], [], [], []))
            continue
        at, spans = 0, []
        for side in (bytes_a, bytes_b):
            at, own = 0, []
            for x in side:
                own.append((at, at + len(x)))
                at += len(x)
            spans.append(own)
        links, low = [], 0
        for x, (s, e) in zip(a, spans[0]):
            while spans[1][low][1] <= s:
                low += 1
            k = low
            while k < len(b) and spans[1][k][0] < e:
                links.append((x, b[k]))
                k += 1
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, pa, pb = [], 0, 0
        for cut in cuts:
            ga, gb = [], []
            while pa < len(a) and spans[0][pa][1] <= cut:
                ga.append(a[pa])
                pa += 1
            while pb < len(b) and spans[1][pb][1] <= cut:
                gb.append(b[pb])
                pb += 1
            groups.append((ga, gb))
        per_row.append((i, a, b, groups, links))
        counts.update(set(links))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    found = []
    for i, a, b, groups, links in per_row:
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(written.encode()).hexdigest() if a else ""
        n_best = sum(counts[p] == best[p[0]] for p in links)
        found.append((i, len(a), len(b), len(groups), len(links), n_best, sum(counts[p] for p in links), digest))
    return sorted(found, key=repr)


NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def collected(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=repr)


HARD = [
    (50, "<s>a</s> <unk> <0x41>"), (51, "under▁score"), (52, "a\x00b"), (53, "  two  blanks  "), (54, "\r\n\ttabs"),
    (55, "İstanbul ﬁ Å Å"), (56, "12345 678 <|endoftext|><|endoftext|>"), (57, " "), (58, "日本語のテキスト。"),
]


@pytest.mark.parametrize("clashing", [False, True])
def test_edges(spark, both, clashing):
    rows = EDGES + HARD
    assert collected(ta.link_statistics(documents(spark, rows, clashing), packet_bytes=300)) == brute(rows, both)
    assert ta.link_statistics(documents(spark, rows).limit(0)).collect() == []


def test_query(spark, both):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = ta.op13_token_alignment(spark, SF_DIR)
    assert collected(found) == brute([(r.doc_id, r.text) for r in docs.collect()], both)
    assert found.columns == list(NAMES)


@pytest.mark.parametrize("between", [" ", "  ", " \n", "\n ", "\t"])
def test_texts_in_parts(both, between, monkeypatch):
    monkeypatch.setattr(ta, "MOST_KNOWN", 5)
    rng = random.Random(3)
    tokens = ta.Tokens()
    for n in (1, 2, 400):
        text = between.join(rng.choice(["alpha", "be", "Gamma's", "x1", "é", "\n", "1 2", "'ll", "…", "日本"]) for _ in range(n)) + rng.choice(["", between])
        a, b = tokens.ids(text)
        assert a.tolist() == both[0].encode(" " + text, add_special_tokens=False).ids
        assert b.tolist() == both[1].encode(text)


@pytest.mark.parametrize("seed", range(60))
def test_align_against_common_ends(seed):
    rng = random.Random(seed)
    total = rng.choice([1, 2, 5, 40, 400])
    share = rng.choice([0.1, 0.5, 0.95, 1])
    shared = {k for k in range(1, total) if rng.random() < share}
    a, b = (sorted(shared | {k for k in range(1, total) if rng.random() < rng.choice([0, 0.05])} | {total}) for _ in range(2))
    stretches, groups, links = ta.align(np.array(a), np.array(b))
    cuts = []
    for i, j, n in stretches.tolist():
        assert a[i : i + n] == b[j : j + n]
        cuts += a[i : i + n]
    for i, last_i, j, last_j in groups.tolist():
        assert last_i - i != 1 or last_j - j != 1
        cuts.append(a[last_i - 1])
    assert sorted(cuts) == sorted(set(a) & set(b))
    overlap = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(([0] + a)[i], ([0] + b)[j]) < min(a[i], b[j])]
    found = [tuple(x) for x in links.tolist()] + [(i + k, j + k) for i, j, n in stretches.tolist() for k in range(n)]
    assert sorted(found) == overlap


def test_groups_per_document(spark, both):
    rows = [(1, "Hello tokenizers, unusual wordzz!"), (2, None)]
    found = {r.doc_id: r for r in ta.align_tokens(documents(spark, rows)).collect()}
    assert sum(g.tokens_a for g in found[1].groups) == len(found[1].ids_a)
    assert sum(g.tokens_b for g in found[1].groups) == len(found[1].ids_b)
    assert len(found[1].groups) == brute(rows, both)[0][3] and found[2].groups == []
