import random

import pytest

from holdfast.llm import language_id as li
from tests.conftest import SF_DIR
from tests.llm.helpers import EDGES, documents

WORDS = {
    "en": "the of and to in that was his with they which from have not are this",
    "de": "der die und das nicht von sie ist des sich mit dem dass auf eine auch",
    "xx": "zuk qox vuz kix zaq wok xuv qiz kuzo vaxi zowq kuvo",
}


def text(rng, language, n=60):
    return " ".join(rng.choice(WORDS[language].split()) for _ in range(n))


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, look int, logs string")


def test_evidence_is_fused(spark):
    rng = random.Random(1)
    rows = [(k, text(rng, "en" if k % 3 else "de"), "en" if k % 3 else "de", "a.example.org" if k % 3 else "b.example.de", 1, "x") for k in range(300)]
    rows += [
        (1000, text(rng, "de"), "en", "a.example.org", 1, "x"),  # a clear text outweighs the rest
        (1001, "mit", None, "b.example.de", 1, "x"),
        (1002, None, "en", "a.example.org", 1, "x"),
        (1003, "123 456", "en", None, 1, "x"),
        (1004, "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(300)), "en", "a.example.org", 1, "x"),
        (None, text(rng, "en"), "EN-us", "", 1, "x"),
        (1005, "they have QXZV7KJW9PLMNBX2QWZR not", "en", "a.example.org", 1, "x"),  # a key in a short text
    ]
    found = {r.doc_id: (r.language, r.kept) for r in li.identify(li.document_evidence(rows_of(spark, rows))).collect()}
    assert all(found[k] == (("en" if k % 3 else "de"), True) for k in range(300))
    assert found[1000] == ("de", True) and found[1001] == ("de", True) and found[None] == ("en", True)
    assert found[1005] == ("en", True)
    assert found[1002] == found[1003] == found[1004] == ("und", False)
    kept = li.keep_identified(rows_of(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "look", "logs"] and kept.count() == len(rows) - 3


def test_hosts_decide_where_texts_do_not(spark):
    """One word that both languages have: the host's own history is the difference."""
    rng = random.Random(2)
    rows = []
    for k in range(400):
        language = "de" if k % 2 else "en"
        rows.append((k, text(rng, language) + " zzqqzz", None if k % 4 > 1 else language, f"{language}.host.net", 1, "x"))
    rows += [(900, "zzqqzz", None, "de.host.net", 1, "x"), (901, "zzqqzz", None, "en.host.net", 1, "x")]
    found = {r.doc_id: r for r in li.identify(li.document_evidence(rows_of(spark, rows))).collect()}
    assert (found[900].language, found[901].language) == ("de", "en")


def test_edges_and_empty_tables(spark):
    for clashing in (False, True):
        df = documents(spark, EDGES, clashing)
        assert li.identify(li.document_evidence(df)).count() == len(EDGES)
        assert li.keep_identified(df).columns == df.columns
    assert li.identify(li.document_evidence(documents(spark, EDGES).limit(0))).collect() == []
    undeclared = documents(spark, EDGES).drop("lang", "source")
    assert {(r.language, r.kept) for r in li.identify(li.document_evidence(undeclared)).collect()} == {("und", False)}


def test_pages(spark):
    html = "<HTML class=a lang='DE-at'><script>var the = 1</script><style>p</style><!-- the -->{}&amp;<b>der</b></html>"
    rows = [(1, "http://u@A.b.example.de:80/x", html.format("und")), (2, None, None), (None, "x", "plain")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r for r in li.page_evidence(pages).collect()}
    assert (found[1].declared, found[1].host, found[1].text.split()) == ("de", "a.b.example.de", ["und", "der"])
    assert (found[2].declared, found[2].host, found[2].text, found[None].text) == ("", "", "", "plain")


def test_held_out_accuracy(spark):
    """Declarations of a fifth of the rows are hidden; their languages are found from the rest."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    hidden = docs.withColumn("lang", F.when(F.col("doc_id") % 5 != 0, F.col("lang")))
    found = {r.doc_id: r.language for r in li.identify(li.document_evidence(hidden)).collect()}
    wanted = [(r.doc_id, r.lang) for r in docs.collect() if r.doc_id % 5 == 0]
    assert sum(found[i] == lang for i, lang in wanted) / len(wanted) >= 0.95


def many_languages(rng, languages):
    """Clean rows of each of many languages, some of them rare, with words of their own."""
    rows = []
    for k in range(languages):
        tag = chr(97 + k // 26) + chr(97 + k % 26)
        own = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(12)]
        for _ in range(3 if k % 10 else 5):
            rows.append((len(rows), " ".join(rng.choice(own) for _ in range(40)), tag, "a.example.org", 1, "x"))
    return rows


def test_every_declared_language_is_known(spark):
    rows = many_languages(random.Random(3), 80)
    found = li.identify(li.document_evidence(rows_of(spark, rows))).collect()
    assert {(r.doc_id, r.language, r.kept) for r in found} == {(i, tag, True) for i, _, tag, *_ in rows}


def test_blocks_of_languages_give_the_same(spark):
    rows = many_languages(random.Random(4), 25)
    evidence = li.document_evidence(rows_of(spark, rows))
    one, three = ({(r.doc_id, r.language, r.probability) for r in li.identify(evidence, b).collect()} for b in (256, 10))
    assert one == three and len(one) == len(rows)


@pytest.mark.parametrize("tags", [0, 1, 10, 300])
def test_rare_tags_do_not_take_the_part_of_unknown(spark, tags):
    """Texts that are like no language stay rejected, however many tags single rows declare."""
    rng = random.Random(7)
    rows = [(k, text(rng, "en" if k % 3 else "de", 200), "en" if k % 3 else "de", "a.org", 1, "x") for k in range(300)]
    gibberish = ["".join(rng.choice("bcdfghjklmnpqrstvwxz") if rng.random() < 0.85 else " " for _ in range(rng.choice([60, 400]))) for _ in range(40)]
    rows += [(1000 + k, g, None, "b.org", 1, "x") for k, g in enumerate(gibberish)]
    names = [a + b + c for a in "qxyz" for b in "abcdefghij" for c in "klmnopqrst"][:tags]
    rows += [(2000 + k, "hello world", name, "c.org", 1, "x") for k, name in enumerate(names)]
    found = {r.doc_id: r for r in li.identify(li.document_evidence(rows_of(spark, rows))).collect()}
    assert [found[1000 + k].kept for k in range(40)] == [False] * 40
    assert all(found[k].kept and found[k].language == ("en" if k % 3 else "de") for k in range(300))


def test_languages_of_three_rows_are_known(spark):
    rng = random.Random(9)
    vocabularies = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 7))) for _ in range(40)] for _ in range(80)]
    rows = [
        (3 * k + j, " ".join(rng.choice(words) for _ in range(80)), f"{chr(97 + k // 26)}{chr(97 + k % 26)}", f"h{k}.org", 1, "x")
        for k, words in enumerate(vocabularies)
        for j in range(3)
    ]
    found = {r.doc_id: r for r in li.identify(li.document_evidence(rows_of(spark, rows))).collect()}
    assert sum(found[i].kept and found[i].language == lang for i, _, lang, *_ in rows) >= 0.99 * len(rows)
