import math
import zlib
from collections import Counter

import numpy as np
import pytest

from holdfast.llm import lm_scoring as lm
from tests.llm.helpers import EDGES, documents


def tokens(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + [""]


def brute_base(rows):
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    counts = Counter(w for (_, t), h in zip(rows, held) if not h for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    found = []
    for (i, t), h in zip(rows, held):
        own = tokens(t)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        found.append((i, h, len(own), sum(counts[w] > 0 for w in own), n, round(base, 5)))
    return sorted(found, key=repr)


def base(scores):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in scores), key=repr)


@pytest.mark.parametrize("known, clashing", [(1 << 17, False), (3, True), (0, False)])
def test_edges(spark, known, clashing):
    scores = lm.score(documents(spark, EDGES, clashing), known).collect()
    assert base(scores) == brute_base(EDGES)
    assert all(r.score < 0 and math.isfinite(r.score) for r in scores)
    assert lm.score(documents(spark, EDGES).limit(0), known).collect() == []


def test_held_out_texts_are_likelier_than_by_word_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scores = lm.score(docs).collect()
    assert base(scores) == brute_base([(r.doc_id, r.text) for r in docs.collect()])
    held = [r for r in scores if r.held_out]
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert gain > 0.1


def test_probabilities_add_up_to_one():
    rng = np.random.default_rng(3)
    values = rng.normal(0, 1, len(lm.first_parameters(np.full(lm.SYMBOLS, 1 / lm.SYMBOLS)))).astype(np.float32)
    context = np.repeat(rng.integers(0, lm.SYMBOLS, (lm.CONTEXT, 3)), lm.SYMBOLS, axis=1)
    target = np.tile(np.arange(lm.SYMBOLS), 3)
    sums = (10 ** lm.log_probabilities(values, context, target)).reshape(3, -1).sum(axis=1)
    assert np.allclose(sums, 1, atol=1e-4)


def test_training_lowers_the_loss_of_a_pattern():
    unigram = np.full(lm.SYMBOLS, 1 / lm.SYMBOLS)
    symbols = np.tile(np.arange(8), 2000)
    firsts = np.array([0, len(symbols)])
    trainer = lm.Trainer(lm.first_parameters(unigram), unigram, 1)
    for _ in range(12):
        trainer.train(symbols, firsts, 0)
    after = lm.log_probabilities(trainer.values, lm.contexts(symbols, firsts, 0), symbols)[10:]
    assert after.mean() > math.log10(0.5)


def test_contexts_stop_at_documents():
    found = lm.contexts(np.array([1, 2, 3, 4, 5]), np.array([0, 2, 2, 5]), 9)
    assert found.tolist() == [[9, 1, 9, 3, 4], [9, 9, 9, 9, 3], [9, 9, 9, 9, 9]]


def test_probability_of_words_in_a_class_adds_up(spark):
    """Known words and one unseen word share each class."""
    rows = [(k, f"w{k}a w{k}b common common x{k % 5}") for k in range(400)]
    counts = lm.word_counts(documents(spark, rows))
    data = lm.vocabulary(counts)
    words = lm.Vocabulary(data)
    mass = np.zeros(lm.SYMBOLS)
    for r in counts.collect():
        symbol = words.symbols([r.word.encode()])[0][0]
        mass[symbol] += (r.n + 1) / data["class_size"][symbol] if data["class_size"][symbol] else 1
    classes = data["class_size"] > 0
    assert np.allclose(mass[classes] + 1 / data["class_size"][classes], 1)
    assert (mass[~classes] <= 1).all()


def test_only_short_words_are_sent_to_the_tasks(spark, monkeypatch):
    monkeypatch.setattr(lm, "COUNTED_BYTES", 100)
    long = "字" * 30
    rows = [(i, f"{long} a{'b' * 62} {'c' * 65} w{i % 3}") for i in range(40)]
    counts = lm.word_counts(documents(spark, rows).repartition(2))
    assert {(r.word, r.n) for r in counts.collect()} >= {(long, 40), ("c" * 65, 40), ("", 40), ("w0", 14)}
    assert {w for w, _ in lm.frequent(counts)} == {"", "a" + "b" * 62, "w0", "w1", "w2"}
    assert base(lm.score(documents(spark, rows)).collect()) == brute_base(rows)
