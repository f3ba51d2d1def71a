import random

import numpy as np
import pytest
import xxhash

from holdfast.llm.simhash import anchors, at_home, fingerprint, group_links, simhash_classes, tree_links, without_near_copies
from tests.conftest import SF_DIR
from tests.llm.helpers import EDGES, documents


def brute_print(text: str | None, size: int = 3) -> int:
    raw = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        raw = raw.replace(blank, " ")
    words = [w for w in raw.split(" ") if w]
    parts = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(rows, threshold=2):
    prints = [(i, brute_print(t)) for i, t in rows]
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= threshold:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            r = find(k)
            least[r] = min(i, least.get(r, i))
    return sorted(((i, f"{p:016x}", least.get(find(k))) for k, (i, p) in enumerate(prints)), key=repr)


def as_rows(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=repr)


def test_all_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert as_rows(simhash_classes(docs)) == brute_classes([(r.doc_id, r.text) for r in docs.collect()])


def test_edges(spark):
    base = [f"word{i}" for i in range(400)]
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one TWO"), (None, "one two"), (None, None), (7, "É x y z")]
    rows += [(7, "É x y z"), (8, " ".join(base)), (9, " ".join(["other"] + base)), (10, " ".join(base * 300))]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, code string, root int")
    assert as_rows(simhash_classes(docs)) == brute_classes(rows)
    assert simhash_classes(docs.limit(0)).collect() == []


def test_chain_of_close_prints_is_one_component(spark):
    from holdfast.llm.simhash import fingerprint_components

    chain = [(1 << k) - 1 for k in range(0, 60, 2)] + [(1 << 62) | (1 << 61) | (1 << 60) | 5 << 20]
    codes = spark.createDataFrame([(c,) for c in chain], "code long")
    found = {r.node: r.root for r in fingerprint_components(codes).collect()}
    assert found == {c: 0 for c in chain[1:-1]}


def test_anchors_are_code_words_that_cover_every_value():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 31, 500)
    which, words, bits = anchors(values)
    home = at_home(bits)
    near = np.bitwise_count(values[which] ^ words)
    assert near.max() <= 2 and near[home].max() <= 1 and home.sum() == len(values)
    own = {(int(w), int(a)) for w, a in zip(which, words)}
    for k, flip in enumerate(rng.integers(0, 31, 500)):
        _, other_words, other_bits = anchors(np.array([values[k] ^ (1 << int(flip))]))
        assert (k, int(other_words[at_home(other_bits)][0])) in own


def test_large_groups_lose_no_link():
    rng = random.Random(3)
    centre = rng.getrandbits(63)
    codes = {centre}
    while len(codes) < 21_000:
        code = centre
        for b in rng.sample(range(63), 4):
            code ^= 1 << b
        codes.add(code)
    values = np.array(sorted(codes), dtype=np.int64)[:21_000]

    def parts(pairs):
        root = {int(v): int(v) for v in values}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in zip(*pairs):
            root[find(int(a))] = find(int(b))
        return len({find(int(v)) for v in values})

    assert parts(group_links(values, values, 2)) == parts(tree_links(values, values, 2))


@pytest.mark.parametrize("text", ["", "a", "a b", "a b c", "a b c a b c", "Ä Ö ü\x0bX"])
def test_fingerprint(text):
    assert fingerprint(text.encode()) == brute_print(text)


def brute_stay(rows):
    """Ids and texts that stay: of every component that of the least id, null ids last."""
    distinct = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    prints = [brute_print(t) for _, t in distinct]
    root = list(range(len(distinct)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(distinct)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return [distinct[k] for k in range(len(distinct)) if find(k) == k]


def test_one_document_of_each_component_stays(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = without_near_copies(docs)
    assert found.columns == docs.columns
    expected = brute_stay([(r.doc_id, r.text) for r in docs.collect()])
    assert len(expected) < docs.count()
    assert sorted(r.doc_id for r in found.collect()) == [i for i, _ in expected]


@pytest.mark.parametrize("clashing", [False, True])
def test_stage_edges(spark, clashing):
    df = documents(spark, EDGES, clashing)
    found = without_near_copies(df)
    assert found.columns == df.columns
    # Empty texts are copies of each other, and so are the texts "one".
    assert sorted((r.doc_id for r in found.collect()), key=repr) == sorted((i for i, _ in brute_stay(EDGES)), key=repr)
    assert without_near_copies(df.limit(0)).collect() == []
