import hashlib
import random
import re

import pytest

from holdfast.llm import fill_middle as fm
from tests.llm.helpers import EDGES, documents


def brute(rows, fim=100, spm=50, seed=7):
    found = []
    for i, text in rows:
        text = text or ""
        digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
        h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        lo, hi = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
        p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
        if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim:
            found.append((i, len(units), "plain", None, None, text))
        elif h[3] % 100 < spm:
            found.append((i, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"))
        else:
            found.append((i, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"))
    return sorted(found, key=repr)


def collected(df):
    return sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in df.collect()), key=repr)


def lines(seed):
    rng = random.Random(seed)
    return [
        (k, "".join(rng.choice(["a", "é", "😀", "\n", "\r", "<", "<S", "P>", ">", "M"]) for _ in range(rng.randint(0, 60)))) for k in range(150)
    ]


HARD = [(60, "a<P>b\nc"), (61, "x\n<S>\n"), (62, "<M>"), (63, "<\n<P\n>"), (64, "\n"), (65, "\n\n"), (66, "end\n"), (67, "two\nlines")]


@pytest.mark.parametrize("clashing", [False, True])
def test_edges(spark, clashing):
    rows = EDGES + HARD
    found = fm.fill_in_middle(documents(spark, rows, clashing))
    assert collected(found) == brute(rows)
    assert set(found.columns) >= {"doc_id", "lang", "source", "n", "form", "output"} and "text" not in found.columns
    assert fm.fill_in_middle(documents(spark, rows).limit(0)).collect() == []


def test_result_names_in_the_input(spark):
    rows = spark.createDataFrame([(1, "a\nb", "x", 5)], "doc_id long, text string, form string, n int")
    assert collected(fm.fill_in_middle(rows)) == brute([(1, "a\nb")])


@pytest.mark.parametrize("seed", range(3))
def test_random_lines(spark, seed, monkeypatch):
    rows = lines(seed)
    df = documents(spark, rows)
    assert collected(fm.fill_in_middle(df)) == brute(rows)
    assert collected(fm.fill_in_middle(df, seed=11, fim_percent=60, spm_percent=20)) == brute(rows, 60, 20, 11)


def test_texts_come_back(spark):
    from pyspark.sql import functions as F

    rows = lines(9) + HARD + EDGES
    found = fm.fill_in_middle(documents(spark, rows))
    texts = found.select("doc_id", fm.restored(F.col("form"), F.col("output")).alias("t")).collect()
    assert sorted(((r.doc_id, r.t) for r in texts), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)


def test_slices_of_a_batch():
    import numpy as np
    import pyarrow as pa

    rows = lines(4)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([i for i, _ in rows]), pa.array([t for _, t in rows]), *(pa.array(np.arange(len(rows)) * k) for k in (3, 7, 11, 13))],
        names=["row", "text", "h0", "h1", "h2", "h3"],
    )
    whole = pa.Table.from_batches(list(fm._transformed([batch], 100, 50)))
    real, fm.SLICE_BYTES = fm.SLICE_BYTES, 100
    try:
        parts = list(fm._transformed([batch.slice(0, 70), batch.slice(70)], 100, 50))
    finally:
        fm.SLICE_BYTES = real
    assert len(parts) > 10 and pa.Table.from_batches(parts).to_pylist() == whole.to_pylist()
