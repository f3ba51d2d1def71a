"""Searches over the index of texts in ids."""

import random
import re

import pytest
from pyspark.sql import functions as F

from holdfast.operators.filters import CustomerFilter, like_pattern
from holdfast.session import scratch_path
from holdfast.sources import grams
from holdfast.sources.results import ResultStore
from tests.helpers import prediction, predictions, recommendations, segments

BUCKETS = 300  # more than there are parts


def sample_ids():
    rng = random.Random(4)
    ids = {"C%05d" % rng.randrange(10**5) for _ in range(60)} | {"".join(rng.choice("aBc_%\\9") for _ in range(rng.randrange(1, 14))) for _ in range(60)}
    return sorted(ids | {"Ärger-Ö", "😀x😀y", "SYN_00001", "x" * 40})


IDS = sample_ids()
SEARCHES = [
    "C0", "c00", "SYN_00001", "syn\\_0", "%", "_", "\\%", "\\\\", "a%c", "a_c", "ÄRGER", "😀Y", "9", "x" * 20, "x" * 41, "nothing like it",
    "c%1%2", "bac", "B\\", " ", *IDS[::9],
]


@pytest.fixture(scope="module")
def store(spark):
    own = ResultStore(spark, scratch_path(spark, "searched"), BUCKETS)
    rows = [prediction(i, n / 1000) for n, i in enumerate(IDS)]
    named = segments(spark, [(i, 1, "Service Issue Segment") for i in IDS])
    advised = recommendations(spark, [(i, "Tariff Optimization", "because", "High") for i in IDS])
    own.publish(own.create_job({}), predictions(spark, rows), named, advised)
    return own


def ids(df):
    return sorted(r["customer_id"] for r in df.select("customer_id").collect())


def brute_matches(text):
    parts = re.findall(r"\\(.)|([%_])|(.)", like_pattern(text), flags=re.DOTALL)
    pattern = "".join(".*" if w == "%" else "." if w else re.escape(e or p) for e, w, p in parts)
    return sorted(i for i in IDS if re.fullmatch(pattern, i.lower(), flags=re.DOTALL))


def parts_of(spark, wanted):
    rows = spark.createDataFrame([(i,) for i in wanted], "customer_id string")
    return sorted({r[0] for r in rows.select(grams.part_of(BUCKETS)).collect()})


def test_same_rows_with_and_without_the_index(spark, store):
    whole = store.published()["predictions"].cache()
    layout = {"job_1": list(range(256))}
    for text in SEARCHES:
        found = brute_matches(text)
        assert ids(CustomerFilter(search=text).apply(whole)) == found, text
        held = store._search_parts(layout, text)
        assert set(parts_of(spark, found)) <= set(held), text
        # One text of at most GRAM characters and no other wildcard: just the parts that are needed.
        if grams.literal_runs(text) == [text.lower()] and len(text) <= grams.GRAM:
            assert held == parts_of(spark, found), text
    for text in SEARCHES[:6]:
        assert ids(CustomerFilter(search=text).apply(store.published(search=text)["predictions"])) == brute_matches(text)


def test_a_search_reads_the_parts_that_can_match(store):
    for text, most in (("SYN_00001", 1), ("nothing like it", 0), ("ärger", 1)):
        found = store.published(search=text)
        joined = CustomerFilter(search=text).apply(found["predictions"]).join(found["customer_segments"], "customer_id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert not most or len(re.findall(r"PartitionFilters: \[[^\]]*holdfast_part", plan)) == 2
        # Spark reads the buckets side by side, without an exchange.
        assert "Exchange hashpartitioning" not in plan
        files = {f for name in found for f in found[name].inputFiles()}
        assert len(files) <= 3 * most
        assert ids(joined) == brute_matches(text)


def test_literal_texts():
    assert grams.literal_runs("a%B_c") == ["a", "b", "c"] and grams.literal_runs("%_%") == []
    assert grams.literal_runs("\\%a\\_\\b") == ["%a_b"] and grams.literal_runs("x\\") == ["x%"]
    assert grams.wanted_grams("abcdefghij%z") == ["abcdefgh", "bcdefghi", "cdefghij", "z"]
    assert len(grams.wanted_grams("".join(map(chr, range(97, 123))))) == grams.MOST_GRAMS


def test_grams_by_their_definition(spark):
    rows = spark.createDataFrame([("Ab1",), ("b1",), ("",), (None,), ("123456789",)], "customer_id string")
    found = {r["gram"]: r for r in grams.grams(rows, 300).collect()}
    assert set(found) == {"ab1", "b1", "1", *("123456789"[i : i + 8] for i in range(9))}
    place = {r[0]: r[1] for r in rows.select("customer_id", grams.part_of(300)).collect()}
    for gram, owners in (("b1", ("Ab1", "b1")), ("9", ("123456789",))):
        bits = {64 * k + b for k in range(grams.WORDS) for b in range(64) if found[gram][f"parts_{k}"] >> b & 1}
        assert bits == {place[o] for o in owners}


def test_amended_and_older_results(spark, store):
    own = ResultStore(spark, scratch_path(spark, "amended"), 4)
    rows = [prediction(f"C{i:05d}") for i in range(40)]
    empty = segments(spark, []), recommendations(spark, [])
    own.publish(own.create_job({}), predictions(spark, rows), *empty)
    tables = own.published()
    changed = tables["predictions"].withColumn("main_risk_factor", F.when(F.col("customer_id") != "C00007", F.col("main_risk_factor")))
    own.amend({**tables, "predictions": changed})
    for text in ("C00007", "c0003", "%9"):
        found = CustomerFilter(search=text).apply(own.published(search=text)["predictions"])
        assert ids(found) == sorted(r[0] for r in rows if text.strip("%").lower() in r[0].lower())
    # Without an index nothing is left out.
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{own.root}/id_grams")
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    assert own.published(search="C00007")["predictions"].count() == 40
    assert all(df.isEmpty() for df in ResultStore(spark, scratch_path(spark, "none")).published(search="C").values())
