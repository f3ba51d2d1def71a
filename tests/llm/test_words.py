"""Names of words and of word sequences."""

import random

import numpy as np
import pytest

from holdfast.llm import substring_dedup
from holdfast.llm.words import LONG_WORD, Namer
from tests.llm.helpers import documents


def thue_morse(n):
    return [k.bit_count() & 1 for k in range(n)]


@pytest.mark.parametrize("size", [64, 128, 512, 1024, 4096])
def test_regular_words_differ(size):
    word = bytes(97 + b for b in thue_morse(size))
    other = bytes(98 - b for b in thue_morse(size))
    assert len(set(Namer().words([word, other]).names.tolist())) == 2


@pytest.mark.parametrize("size", [32, 1024, 2048, 8192])
def test_regular_sequences_differ(size):
    texts = [" ".join(pair[b] for b in thue_morse(size)).encode() for pair in ("ab", "ba")]
    words = Namer().words(texts)
    names = words.stretch(words.firsts[:-1], words.firsts[1:])
    assert names[0] != names[1]


def test_names_are_those_of_contents():
    rng = random.Random(4)
    pool = ["a", "b", "ab", "é", "x" * 7, "x" * 8, "x" * 9, "y" * LONG_WORD, "y" * (LONG_WORD + 1), "z" * 1000, "0", "00", "\0", "\0\0"]
    own = [rng.choice(pool) for _ in range(800)]
    words = Namer().words([" ".join(own).encode(), b"", " ".join(own[::-1]).encode()])
    both = own + own[::-1]
    assert words.firsts.tolist() == [0, 800, 800, 1600]
    for size in (1, 2, 5, 40):
        grams, seen = words.grams(size), {}
        for k, name in enumerate(grams.tolist()):
            assert seen.setdefault(tuple(both[k : k + size]), name) == name
        assert len(set(seen.values())) == len(seen)
        begin = np.arange(len(grams))
        assert (words.stretch(begin, begin + size) == grams).all()
    assert Namer().words([b"one"]).grams(2).tolist() == []


def test_texts_that_differ_in_a_regular_word_stay(spark):
    word, other = ("".join(pair[b] for b in thue_morse(1024)) for pair in ("ab", "ba"))
    rows = [(k, " ".join(["w%d" % i for i in range(20)] + [w] + ["v%d" % i for i in range(14)])) for k, w in enumerate((word, other))]
    found = substring_dedup.remove_repeats(documents(spark, rows)).collect()
    assert [r.n_removed for r in found] == [0, 0]
