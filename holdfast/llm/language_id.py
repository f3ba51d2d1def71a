"""Language of texts by Bayesian fusion of evidence (operator 4).

Three kinds of evidence give the posterior of a row's language:

* text: naive Bayes over hashed letter trigrams, counted per declared language over all rows. Trigrams
  of one text depend on each other, so a text counts as ``TEXT_WEIGHT`` trigrams at most, and some are
  foreign to any language, so each language has a ``FOREIGN`` share of all trigrams;
* declared language (of the markup or the metadata): how often rows whose text looks like one
  language declare another, smoothed;
* address: the prior of the host, smoothed towards that of its domain, that towards that of its
  suffix, and that towards all rows. Counts come from grouped aggregation of what the texts alone
  say, and each row's own count is taken out before it is judged.

``und`` is a further hypothesis: uniform over trigrams, for texts like no known language. A language of
which little text was seen is nearly uniform as well, so its prior is lowered, below that of ``und`` at last:
a rare or mistaken tag does not take over the texts that are like none. A row is rejected if ``und`` is
the best, if the best has a posterior under ``LEAST_PROBABILITY``, or if its text has no letters, as
addresses alone prove nothing about a text.

The languages are all that are declared, by however few rows. They are scored in blocks of
``LANGUAGE_BLOCK``: the trigram table of one block at a time is sent to the tasks, which bounds it, and
texts are written once more for each further block. Counts per host and per declaration are maps of
the languages that occur; they are joined, narrow and without the text.

Defined results: null and empty texts have no letters; null or empty declarations and hosts are a kind
of their own; on equal posteriors the language first in the alphabet wins; a table in which nothing is
declared has no languages and rejects all rows; repeated rows and null ids keep their own row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.tables import KEYS, fresh, lower_ascii, plain_text, read_table, row_keys, saved
from holdfast.llm.words import slices

LANGUAGE_BLOCK = 256
BUCKET_BITS = 14
TEXT_WEIGHT = 200
# Share of a text's trigrams that may be foreign to its language: names, keys, addresses.
FOREIGN = 0.2
# Weight of the wider level, in rows, when a narrower one is smoothed.
SMOOTHING = 10.0
LEAST_PROBABILITY = 0.5
UNKNOWN, UNKNOWN_PRIOR = "und", 1e-3
# Prior of a language of which next to no text was seen.
LEAST_KNOWN = UNKNOWN_PRIOR / 10

_LETTERS = np.array([c >= 128 or chr(c).isalpha() for c in range(256)])


# ---- text


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of every trigram around a letter; what is no letter is a blank."""
    data = np.frombuffer(b"\n" + b"\n".join(texts).lower() + b"\n", dtype=np.uint8)
    letter = _LETTERS[data]
    clean = np.where(letter, data, 32).astype(np.uint32)
    middle = np.flatnonzero(letter)
    code = clean[middle - 1] << np.uint32(16) | clean[middle] << np.uint32(8) | clean[middle + 1]
    bucket = (code * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)
    starts = np.cumsum([1] + [len(t) + 1 for t in texts])
    return bucket.astype(np.int64), np.searchsorted(starts, middle, side="right") - 1


def _counted(batches: Iterator[pa.RecordBatch], languages: list[str]) -> Iterator[pa.RecordBatch]:
    number = {n: i for i, n in enumerate(languages)}
    counts = np.zeros((len(languages), 1 << BUCKET_BITS), dtype=np.int64)
    for batch, texts in slices(batches):
        bucket, text = trigrams(texts)
        own = np.array([number[d] for d in batch.column(0).to_pylist()])
        for k in np.unique(own):
            counts[k] += np.bincount(bucket[own[text] == k], minlength=1 << BUCKET_BITS)
    language, bucket = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(language.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(counts[language, bucket])],
        names=["language", "bucket", "n"],
    )


def _likelihoods(batches: Iterator[pa.RecordBatch], table: np.ndarray, last: bool = True) -> Iterator[pa.RecordBatch]:
    """Per row the number of trigrams and the tempered log-likelihoods, after those of earlier blocks.

    The text and the likelihood of ``und``, the last row of ``table``, are for the other and the last block.
    """
    if not last:
        table = table[:-1]
    for batch, texts in slices(batches):
        bucket, text = trigrams(texts)
        n = np.bincount(text, minlength=len(texts))
        weight = np.minimum(1.0, TEXT_WEIGHT / np.maximum(n, 1))
        logs = np.stack([np.bincount(text, weights=row[bucket], minlength=len(texts)) * weight for row in table], axis=1)
        if "logs" in batch.schema.names:
            earlier = batch.column(batch.schema.get_field_index("logs")).flatten().to_numpy().reshape(len(texts), -1)
            logs = np.concatenate([earlier, logs], axis=1)
        flat = pa.array(logs.ravel())
        offsets = pa.array(np.arange(0, logs.size + 1, logs.shape[1], dtype=np.int32))
        dropped = ("text", "trigrams", "logs") if last else ("trigrams", "logs")
        kept = [i for i, f in enumerate(batch.schema.names) if f not in dropped]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in kept), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, flat)],
            names=[*(batch.schema.names[i] for i in kept), "trigrams", "logs"],
        )


def declared_languages(evidence: DataFrame) -> list[str]:
    """All declared languages, in alphabetical order. Tags of two or three letters bound their number."""
    return sorted(r["declared"] for r in evidence.filter("declared != ''").select("declared").distinct().collect())


def trigram_table(evidence: DataFrame, languages: Sequence[str]) -> tuple[np.ndarray, list[float]]:
    """Log-probability of each bucket under each language, and under ``und`` in the last row; and for each
    language the log of how far it is known, from ``LEAST_KNOWN`` to 1.
    """
    labelled = evidence.filter(F.col("declared").isin(*languages)).select("declared", "text")
    names = list(languages)
    rows = (
        labelled.mapInArrow(lambda b: _counted(b, names), "language int, bucket int, n long")
        .groupBy("language", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    counts = np.full((len(names) + 1, 1 << BUCKET_BITS), 0.5)
    counts[rows["language"], rows["bucket"]] += rows["n"]
    seen = counts[:-1].sum(axis=1) - 0.5 * (1 << BUCKET_BITS)
    known = LEAST_KNOWN + (1 - LEAST_KNOWN) * (seen / (seen + (1 << BUCKET_BITS))) ** 2
    shares = counts / counts.sum(axis=1, keepdims=True)
    shares[:-1] = (1 - FOREIGN) * shares[:-1] + FOREIGN / (1 << BUCKET_BITS)
    return np.log(shares), np.log(known).tolist()


# ---- evidence


def language_tag(column: Column) -> Column:
    """First part of a language tag, lower-cased; empty if there is none."""
    return F.coalesce(lower_ascii(F.regexp_extract(column, "^\\s*([A-Za-z]{2,3})(?![A-Za-z])", 1)), F.lit(""))


def document_evidence(docs: DataFrame) -> DataFrame:
    """Documents: the declared language is ``lang``, the host ``source``. Missing columns are no evidence."""
    has = {c.lower() for c in docs.columns}
    return docs.select(
        *row_keys(),
        F.lit("document").alias("kind"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.lit(None).cast("long").alias("page_id"),
        (language_tag(F.col("lang").cast("string")) if "lang" in has else F.lit("")).alias("declared"),
        (F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in has else F.lit("")).alias("host"),
        plain_text().alias("text"),
    )


def page_evidence(pages: DataFrame) -> DataFrame:
    """Web pages: language of the ``html`` element, host of the address, and the text without markup."""
    html = F.coalesce(F.col("html"), F.lit(""))
    text = F.regexp_replace(html, "(?is)<(script|style)\\b.*?</\\1\\s*>|<!--.*?-->|<[^>]*>|&[#0-9a-z]+;", " ")
    host = F.regexp_extract(F.coalesce("url", F.lit("")), "^[^/?#]*?://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return pages.select(
        F.coalesce(F.col("page_id").cast("long"), F.lit(-(2**63))).alias("row_id"),
        F.xxhash64(F.col("page_id").isNull(), "url", html).alias("row_text"),
        F.lit("page").alias("kind"),
        F.lit(None).cast("long").alias("doc_id"),
        F.col("page_id").cast("long").alias("page_id"),
        language_tag(F.regexp_extract(html, "(?i)<html\\b[^>]*?\\slang\\s*=\\s*[\"']?([^\"'>\\s]*)", 1)).alias("declared"),
        lower_ascii(host).alias("host"),
        text.alias("text"),
    )


# ---- fusion


def _counts_by(counts: DataFrame, key: str, name: str) -> DataFrame:
    """Rows per language of the text, as a map, by ``key``. Rows of no language count for none."""
    seen = F.when(F.col("look") >= 0, F.struct("look", "n"))
    return (
        counts.groupBy(key, "look")
        .agg(F.sum("n").alias("n"))
        .groupBy(key)
        .agg(F.map_from_entries(F.collect_list(seen)).alias(name))
    )


def host_counts(rows: DataFrame) -> DataFrame:
    """``host`` with the counts ``by_host``, ``by_domain``, ``by_suffix`` and ``by_all``."""
    dotted = F.col("host").contains(".")
    counts = saved(
        rows.groupBy("host", "look")
        .agg(F.count("*").alias("n"))
        .withColumn("domain", F.when(dotted, F.substring_index("host", ".", -2)).otherwise(F.col("host")))
        .withColumn("suffix", F.when(dotted, F.substring_index("host", ".", -1)).otherwise(""))
        .withColumn("everything", F.lit(0))
    )
    hosts = counts.select("host", "domain", "suffix", "everything").distinct()
    for key, name in (("host", "by_host"), ("domain", "by_domain"), ("suffix", "by_suffix"), ("everything", "by_all")):
        hosts = hosts.join(saved(_counts_by(counts, key, name)), key)
    return saved(hosts.select("host", "by_host", "by_domain", "by_suffix", "by_all"))


def _dense(counts: str, size: int) -> Column:
    """A map of counts as an array over all languages."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.coalesce(F.try_element_at(F.col(counts), k), F.lit(0)).cast("double")
    )


def _prior(size: int) -> Column:
    """Smoothed prior of each hypothesis for a row, without the row itself."""

    def without(counts: str) -> Column:
        return F.transform(_dense(counts, size), lambda n, k: F.when(k == F.col("look"), n - 1).otherwise(n))

    def total(counts: Column) -> Column:
        return F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)

    def smoothed(counts: Column, wider: Column) -> Column:
        weight = total(counts) + SMOOTHING
        return F.zip_with(counts, wider, lambda n, p: (n + SMOOTHING * p) / weight)

    prior = F.array_repeat(F.lit(1.0 / size), size)
    for counts in ("by_all", "by_suffix", "by_domain", "by_host"):
        prior = smoothed(without(counts), prior)
    return prior


def declaration_counts(rows: DataFrame, size: int) -> tuple[DataFrame, list[float]]:
    """``declared`` with ``by_declared``, rows per language of the text; and the smoothed total of each language."""
    counts = saved(rows.filter("declared != ''").groupBy("declared", "look").agg(F.count("*").alias("n")))
    # A declaration that no row has is one kind more.
    totals = [float(size + 1)] * size
    for r in counts.filter("look >= 0").groupBy("look").agg(F.sum("n").alias("n")).collect():
        totals[r["look"]] += r["n"]
    return saved(_counts_by(counts, "declared", "by_declared")), totals


def declared_given(totals: Sequence[float]) -> Column:
    """Log-probability of the row's declaration under each language; what is not declared says nothing."""
    whole = F.array(*(F.lit(t) for t in totals))
    logs = F.zip_with(_dense("by_declared", len(totals)), whole, lambda n, t: F.log((n + 1) / t))
    return F.when(F.col("declared") == "", F.array_repeat(F.lit(0.0), len(totals))).otherwise(logs)


IDENTIFIED = ("row_id", "row_text", "kind", "doc_id", "page_id", "declared", "host", "language", "probability", "kept")


def identify(evidence: DataFrame, block: int = LANGUAGE_BLOCK) -> DataFrame:
    """A row per row of ``evidence``: its keys, ``declared``, ``host``, ``language``, ``probability``, ``kept``."""
    languages = declared_languages(evidence)
    size = len(languages)
    if not size:
        return evidence.drop("text").select(
            *IDENTIFIED[:7], F.lit(UNKNOWN).alias("language"), F.lit(1.0).alias("probability"), F.lit(False).alias("kept")
        )
    names = [c for c in evidence.columns if c != "text"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in evidence.schema if f.name != "text")
    texts, weights = evidence.select(*names, "text"), []
    for start in range(0, size, block):
        table, own = trigram_table(evidence, languages[start : start + block])
        last, weights = start + block >= size, weights + own
        found = f"{schema}, {'' if last else 'text string, '}trigrams long, logs array<double>"
        texts = saved(texts.mapInArrow(lambda b, table=table, last=last: _likelihoods(b, table, last), found))
    known = F.slice("logs", 1, size)
    rows = texts.withColumn(
        # Without letters every language is as likely; such rows count for none.
        "look", F.when(F.col("trigrams") > 0, (F.array_position(known, F.array_max(known)) - 1).cast("int")).otherwise(-1)
    )
    priors = F.zip_with(_prior(size), F.array(*map(F.lit, weights)), lambda p, w: F.log(p) + w)
    declarations, totals = declaration_counts(rows, size)
    logs = F.zip_with(known, F.zip_with(priors, declared_given(totals), lambda p, d: p + d), lambda a, b: a + b)
    # ``und`` comes last: where it is level with a language, the language wins.
    all_logs = F.concat(logs, F.array(F.get("logs", F.lit(size)) + float(np.log(UNKNOWN_PRIOR))))
    judged = rows.join(host_counts(rows), "host").join(declarations, "declared", "left").withColumn("posterior", all_logs)
    best = F.array_max("posterior")
    whole = F.aggregate("posterior", F.lit(0.0), lambda a, x: a + F.exp(x - best))
    hypotheses = F.array(*(F.lit(x) for x in [*languages, UNKNOWN]))
    language = F.when(F.col("trigrams") == 0, UNKNOWN).otherwise(
        F.get(hypotheses, (F.array_position("posterior", best) - 1).cast("int"))
    )
    return (
        judged.withColumn("language", language)
        .withColumn("probability", 1.0 / whole)
        .withColumn("kept", (F.col("language") != UNKNOWN) & (F.col("probability") >= LEAST_PROBABILITY))
        .select(*IDENTIFIED)
    )


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` less the rejected ones."""
    names = [fresh(docs, k) for k in KEYS]
    rejected = identify(document_evidence(docs)).filter("NOT kept")
    gone = rejected.select(*(F.col(k).alias(n) for k, n in zip(KEYS, names))).distinct()
    return docs.withColumns(dict(zip(names, row_keys()))).join(gone, names, "left_anti").drop(*names)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and web pages, each judged with what its own table declares."""
    parts = (
        identify(document_evidence(read_table(spark, sf_dir, "documents"))),
        identify(page_evidence(read_table(spark, sf_dir, "pages"))),
    )
    return parts[0].unionByName(parts[1]).drop("row_id", "row_text")
