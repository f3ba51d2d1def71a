import random

import numpy as np
import pytest

from holdfast.llm import minhash_forest as mf
from tests.conftest import SF_DIR
from tests.llm.helpers import EDGES, documents


def words(text):
    raw = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        raw = raw.replace(blank, " ")
    return [w for w in raw.split(" ") if w]


def shingles(text, size=4):
    own = words(text)
    return {tuple(own[i : i + size]) for i in range(max(1, len(own) - size + 1))} if own else set()


def brute(rows):
    """All pairs that share a shingle, by the definition of a link."""
    sets, by_shingle, root = [shingles(t) for _, t in rows], {}, list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k, own in enumerate(sets):
        for s in own:
            by_shingle.setdefault(s, []).append(k)
    seen = {}
    for k, own in enumerate(sets):
        key = frozenset(own)
        if own and key in seen:
            root[find(k)] = find(seen[key])
            continue
        seen[key] = k
        for j in {j for s in own for j in by_shingle[s] if j < k}:
            if find(j) != find(k):
                common = len(own & sets[j])
                if 100 * common >= 80 * (len(own) + len(sets[j]) - common):
                    root[find(j)] = find(k)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    found = []
    for k, (i, _) in enumerate(rows):
        component = least.get(find(k)) if sets[k] else i
        found.append((i, len(sets[k]), component, component is None if i is None or component is None else i == component))
    return sorted(found, key=repr)


def collected(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=repr)


def edited(rng, own, changes, mark="new"):
    own = list(own)
    for place in rng.sample(range(len(own)), changes):
        own[place] = f"{mark}{rng.randrange(10**6)}"
    return own


def families(seed):
    """Copies around the threshold: of long, short and repetitive texts, and on one template."""
    rng, rows = random.Random(seed), []
    for base in range(60):
        n = rng.choice([6, 9, 20, 60, 150, 300])
        own = [f"v{rng.randrange(50 if base % 5 == 0 else 4000)}" for _ in range(n)]
        rows.append(own)
        rows += [edited(rng, own, rng.randint(0, max(1, n // 25))) for _ in range(rng.randint(1, 6))]
    template = [f"t{i}" for i in range(150)]
    for k in range(120):
        own = edited(rng, template, 4, f"own{k}x")
        rows += [own, edited(rng, own, 2, f"copy{k}x")]
    texts = [" ".join(w) for w in rows] + ["spam " * 50, "spam " * 51, "Spam " * 3000, "a b " * 30, "a b " * 31, "a b", "a  B\n", "a b c"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("clashing", [False, True])
def test_edges(spark, clashing):
    df = documents(spark, EDGES, clashing)
    assert collected(mf.near_copies(df)) == brute(EDGES)
    assert mf.near_copies(df.limit(0)).collect() == []


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = mf.op12_minhash_forest(spark, SF_DIR)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert collected(found) == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("options", [{}, {"region": 8, "depth": 3, "block": 3000, "hot": 16}])
def test_families_against_brute_force(spark, options):
    """Also with regions that are cut deeper, crowds, and clusters in many blocks."""
    rows = families(1)
    expected = brute(rows)
    assert len({c for _, _, c, _ in expected}) < 0.7 * len(rows)
    assert collected(mf.near_copies(documents(spark, rows), **options)) == expected


def test_crowd_of_copies_in_blocks(spark):
    """Copies that are close to the original only, in a cluster of many blocks."""
    rng = random.Random(5)
    base = [f"b{rng.randrange(3000)}" for _ in range(200)]
    rows = [(500, " ".join(base))] + [(1000 + k, " ".join(edited(rng, base, 4))) for k in range(300)]
    expected = brute(rows)
    assert collected(mf.near_copies(documents(spark, rows), block=4000, region=64)) == expected


def test_minima_estimate_the_similarity():
    rng = np.random.default_rng(3)
    shared, one, two = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (800, 100, 100))
    found = [mf.minima(np.concatenate([shared, x]), np.array([0, 900])) for x in (one, two)]
    assert abs((found[0] == found[1]).mean() - 0.8) < 0.2
    assert len(np.unique(found[0])) == mf.VALUES


@pytest.mark.parametrize("seed", range(10))
def test_links_connect_what_all_pairs_connect(seed):
    rng = random.Random(seed)
    base = list(range(100))
    sets = []
    for _ in range(60):
        own = set(rng.sample(base, rng.randint(80, 100)))
        sets.append(np.array(sorted(own), dtype=np.uint64))
    node = np.arange(60) * 7
    a, b = mf.linked(node, node, sets, 80)
    close = lambda x, y: 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))
    assert all(close(sets[x // 7], sets[y // 7]) for x, y in zip(a, b))

    def parts(links):
        root = {int(n): int(n) for n in node}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for x, y in links:
            root[find(x)] = find(y)
        return sorted(sorted(n for n in root if find(n) == r) for r in root if find(r) == r)

    every = [(int(node[i]), int(node[j])) for i in range(60) for j in range(i) if close(sets[i], sets[j])]
    assert parts(zip(a, b)) == parts(every)
    assert len(a) == 60 - len(parts(every))
