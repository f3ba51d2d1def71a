"""Log-probabilities of texts by a log-bilinear model (operator 5).

Words map to ``SYMBOLS`` symbols: the most frequent words have one each, all others share classes by
their last two characters (frequent endings have a class each, the rest fall into ``MIXED`` classes).
The model predicts a symbol from the ``CONTEXT`` symbols before it: position weights combine their
vectors to one, whose products with the output vectors, plus a bias, are the scores. It is trained in
numpy by noise-contrastive estimation against the unigram distribution, and scores by batched matrix
products over all symbols, so its probabilities are normalised:

    P(word) = P(symbol | context) * (c + 1) / (tokens of the class + words of the class + 1)

where the second factor is 1 for words with a symbol of their own, and one unseen word per class has
a share. Word counts, classes and training cover all training documents. Each task trains on its own
part from shared parameters, which are then averaged by tokens; ``ROUNDS`` rounds take disjoint
documents, so each is seen once.

The ``KNOWN`` most frequent words at most, of ``KNOWN_BYTES`` each at most, are sent to the tasks with
their counts: 8 MB in all. All other words of a document are joined with the counts, so counts are exact whatever the size of the vocabulary.

Defined results: null and empty texts are one end token; documents with a null id are training
documents; without any training token all counts are zero; repeated rows are documents of their own.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.tables import read_table, saved
from holdfast.llm.words import slices

SYMBOLS, CLASSES, MIXED = 256, 64, 16
CONTEXT, WIDTH, NOISE, BATCH, RATE = 3, 16, 32, 2048, 0.1
KNOWN, KNOWN_BYTES = 1 << 17, 64
# Remainders of training documents in each round; 2 is held out.
FOLDS, HELD_OUT, ROUNDS = 7, 2, ((0, 1, 3), (4, 5, 6))
# Tokens scored at a time: their scores fit into a core's cache.
SCORED_BATCH = 512
# Words a task counts, and bytes of text it counts them in, before it passes them on.
COUNTED, COUNTED_BYTES = 1 << 18, 1 << 27

END = b""


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def fold() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)), F.lit(0))


# ---- counts


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()
    read = 0

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())],
            names=["word", "n"],
        )

    for _, texts in slices(batches):
        for text in texts:
            counts.update(tokens(text))
            read += len(text)
        if len(counts) > COUNTED or read > COUNTED_BYTES:
            yield rows()
            counts.clear()
            read = 0
    if counts:
        yield rows()


def word_counts(training: DataFrame) -> DataFrame:
    """``word``, ``n``: all tokens; the end token is the empty word."""
    return saved(
        training.select("text").mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    )


def frequent(counts: DataFrame, limit: int = KNOWN) -> list[tuple[str, int]]:
    """The most frequent words of ``KNOWN_BYTES`` at most, ``limit`` of them at most; most frequent first.

    Words of one count bin come or go together.
    """
    counts = counts.filter(F.octet_length("word") <= KNOWN_BYTES)
    bin_ = F.floor(F.log2("n") * 8)
    sizes = counts.groupBy(bin_.alias("bin")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect()
    least, words = None, 0
    for row in sorted(sizes, key=lambda r: -r["bin"]):
        words += row["words"]
        if words > limit:
            break
        least = row["least"]
    if least is None:
        return []
    found = [(r["word"], r["n"]) for r in counts.filter(F.col("n") >= least).collect()]
    return sorted(found, key=lambda r: (-r[1], r[0]))


def ending(word: Column) -> Column:
    return F.substring(word, -2, 2)


class Vocabulary:
    """Symbols of words and what is known of their counts. Plain data, so that it can be sent to tasks."""

    def __init__(self, data: dict):
        self.__dict__.update(data)

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbol of each word, and its number among the known words or -1."""
        get = self.known.get
        number = np.array([get(w, -1) for w in words], dtype=np.int64)
        symbol = self.symbol_of[number]
        rare = np.flatnonzero(number < 0)
        if len(rare):
            symbol[rare] = [self.class_of(words[i]) for i in rare.tolist()]
        return symbol, number

    def class_of(self, word: bytes) -> int:
        # Two bytes that are an ending are two characters; other endings are looked up by characters.
        own = self.short_endings.get(word[-2:])
        if own is not None:
            return own
        end = word.decode()[-2:]
        own = self.endings.get(end)
        return own if own is not None else SYMBOLS - MIXED + zlib.crc32(end.encode()) % MIXED


def vocabulary(counts: DataFrame, known: int = KNOWN) -> dict:
    """Data of a ``Vocabulary``. What reaches the driver is bounded by ``known``, ``CLASSES`` and ``MIXED``."""
    spark = counts.sparkSession
    total = counts.agg(F.sum("n"), F.count("*")).first()
    words = frequent(counts, known)
    top = words[: SYMBOLS - CLASSES]
    named = spark.createDataFrame([(w,) for w, _ in top], "word string")
    # The top words are few by definition: their number is the bound of this broadcast.
    rest = counts.join(F.broadcast(named), "word", "left_anti")
    ends = saved(
        rest.groupBy(ending(F.col("word")).alias("end")).agg(F.sum("n").alias("tokens"), F.count("*").alias("words"))
    )
    own = ends.orderBy(F.desc("tokens"), "end").limit(CLASSES - MIXED).collect()
    mixed = (
        ends.join(F.broadcast(spark.createDataFrame([(r["end"],) for r in own], "end string")), "end", "left_anti")
        .groupBy(F.pmod(F.crc32(F.col("end").cast("binary")), F.lit(MIXED)).alias("class"))
        .agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words"))
        .collect()
    )
    symbol_tokens, symbol_words = np.zeros(SYMBOLS), np.zeros(SYMBOLS)
    for i, (_, n) in enumerate(top):
        symbol_tokens[i] = n
    first = SYMBOLS - CLASSES
    endings = {}
    for i, row in enumerate(own):
        endings[row["end"]] = first + i
        symbol_tokens[first + i], symbol_words[first + i] = row["tokens"], row["words"]
    for row in mixed:
        at = SYMBOLS - MIXED + int(row["class"])
        symbol_tokens[at], symbol_words[at] = row["tokens"], row["words"]
    data = {
        "tokens": int(total[0] or 0),
        "words": int(total[1]),
        "known": {w.encode(): i for i, (w, _) in enumerate(words)},
        "endings": endings,
        "short_endings": {e.encode(): k for e, k in endings.items() if len(e) == 2 and e.isascii()},
        "log_counts": np.log10(np.array([n for _, n in words] + [0], dtype=np.float64) + 1),
        "symbol_of": np.zeros(len(words) + 1, dtype=np.int64),
        "unigram": (symbol_tokens + 1) / (symbol_tokens.sum() + SYMBOLS),
        # What the words of a class divide by; words with their own symbol do not.
        "class_size": np.where(np.arange(SYMBOLS) < first, 0.0, symbol_tokens + symbol_words + 1),
    }
    symbols = Vocabulary(data)
    data["symbol_of"][:-1] = [i if i < len(top) else symbols.class_of(w.encode()) for i, (w, _) in enumerate(words)]
    data["symbol_of"][-1] = -1
    data["end"] = next((i for i, (w, _) in enumerate(top) if not w), SYMBOLS - 1)
    return data


# ---- model

_SHAPES = {"inputs": (SYMBOLS, WIDTH), "outputs": (SYMBOLS, WIDTH), "places": (CONTEXT, WIDTH), "bias": (SYMBOLS, 1)}


def unpacked(values: np.ndarray) -> dict[str, np.ndarray]:
    found, start = {}, 0
    for name, shape in _SHAPES.items():
        size = shape[0] * shape[1]
        found[name] = values[start : start + size].reshape(shape)
        start += size
    return found


def first_parameters(unigram: np.ndarray) -> np.ndarray:
    """Small random vectors; the biases alone give the unigram distribution."""
    rng = np.random.default_rng(5)
    parts = {
        "inputs": rng.normal(0, 0.1, _SHAPES["inputs"]),
        "outputs": rng.normal(0, 0.01, _SHAPES["outputs"]),
        "places": np.full(_SHAPES["places"], 1 / CONTEXT),
        "bias": np.log(unigram)[:, None],
    }
    return np.concatenate([parts[n].ravel() for n in _SHAPES]).astype(np.float32)


def contexts(symbols: np.ndarray, firsts: np.ndarray, end: int) -> np.ndarray:
    """Row ``k`` has the symbols ``k + 1`` places before; before a document are end tokens."""
    place = np.arange(len(symbols)) - np.repeat(firsts[:-1], np.diff(firsts))
    found = np.full((CONTEXT, len(symbols)), end, dtype=np.int64)
    for k in range(CONTEXT):
        inside = np.flatnonzero(place > k)
        found[k, inside] = symbols[inside - k - 1]
    return found


def _added(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows of ``values`` by id."""
    order = np.argsort(ids.astype(np.int16), kind="stable")  # short keys are sorted by radix
    ordered = ids[order]
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return ordered[starts], np.add.reduceat(values[order], starts, axis=0)


class Trainer:
    """Noise-contrastive estimation with adaptive steps, in place on the parameters."""

    def __init__(self, values: np.ndarray, unigram: np.ndarray, seed: int):
        self.values = values.copy()
        self.now, self.steps = unpacked(self.values), unpacked(np.full_like(values, 0.01))
        self.rng, self.cumulative = np.random.default_rng(seed), np.cumsum(unigram)
        # The noise term of a symbol: log of its number of noise samples.
        self.expected = np.log(unigram * NOISE).astype(np.float32)

    def step(self, name: str, rows, change: np.ndarray) -> None:
        self.steps[name][rows] += change * change
        self.now[name][rows] += RATE * change / np.sqrt(self.steps[name][rows])

    def batch(self, context: np.ndarray, target: np.ndarray) -> None:
        inputs, outputs, places, bias = (self.now[n] for n in _SHAPES)
        noise = np.minimum(np.searchsorted(self.cumulative, self.rng.random(NOISE)), SYMBOLS - 1)
        before = [inputs[c] for c in context]
        state = sum(b * p for b, p in zip(before, places))
        wanted, other = outputs[target], outputs[noise]
        true = (state * wanted).sum(axis=1) + bias[target, 0] - self.expected[target]
        false = state @ other.T + (bias[noise, 0] - self.expected[noise])
        up = 1 / (1 + np.exp(np.minimum(true, 30)))
        down = -1 / (1 + np.exp(np.minimum(-false, 30)))
        back = up[:, None] * wanted + down @ other
        rows, change = _added(
            np.concatenate([target, noise]),
            np.concatenate(
                [
                    np.concatenate([up[:, None] * state, up[:, None]], axis=1),
                    np.concatenate([down.T @ state, down.sum(axis=0)[:, None]], axis=1),
                ]
            ),
        )
        self.step("outputs", rows, change[:, :-1])
        self.step("bias", rows, change[:, -1:])
        moved = np.stack([(b * back).sum(axis=0) for b in before])
        rows, change = _added(np.concatenate(list(context)), np.concatenate([back * p for p in places]))
        self.step("inputs", rows, change)
        self.step("places", slice(None), moved)

    def train(self, symbols: np.ndarray, firsts: np.ndarray, end: int) -> None:
        context, order = contexts(symbols, firsts, end), self.rng.permutation(len(symbols))
        for start in range(0, len(order), BATCH):
            own = order[start : start + BATCH]
            self.batch(context[:, own], symbols[own])


def _trained(batches: Iterator[pa.RecordBatch], data: dict, values: np.ndarray, seed: int) -> Iterator[pa.RecordBatch]:
    words, trainer, seen = Vocabulary(data), Trainer(values, data["unigram"], seed), 0
    for _, texts in slices(batches):
        found = [tokens(t) for t in texts]
        firsts = np.cumsum([0] + [len(f) for f in found])
        trainer.train(words.symbols([w for f in found for w in f])[0], firsts, data["end"])
        seen += int(firsts[-1])
    if seen:
        weighted = np.append(trainer.values.astype(np.float64), 1.0) * seen
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(weighted), dtype=np.int32)), pa.array(weighted)], names=["place", "value"]
        )


def train(training: DataFrame, data: dict) -> np.ndarray:
    """Parameters after all rounds; their number is fixed, and so is what reaches the driver."""
    spark = training.sparkSession
    values, words = first_parameters(data["unigram"]), spark.sparkContext.broadcast(data)
    for number, folds in enumerate(ROUNDS):
        part = training.filter(F.col("fold").isin(*folds)).select("text")
        sums = (
            part.mapInArrow(
                lambda batches, v=values, n=number: _trained(batches, words.value, v, n), "place int, value double"
            )
            .groupBy("place")
            .agg(F.sum("value").alias("value"))
            .collect()
        )
        if sums:
            ordered = np.array([r["value"] for r in sorted(sums, key=lambda r: r["place"])])
            values = (ordered[:-1] / ordered[-1]).astype(np.float32)
    return values


def log_probabilities(values: np.ndarray, context: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Normalised log10 probabilities of symbols after their contexts."""
    inputs, outputs, places, bias = (unpacked(values)[n] for n in _SHAPES)
    found = np.empty(len(target))
    # One row more than the vectors: the bias, met by a constant.
    columns = np.concatenate([outputs, bias], axis=1).T.copy()
    ones, reach = np.ones(SYMBOLS, dtype=np.float32), np.linalg.norm(columns, axis=0).max()
    for start in range(0, len(target), SCORED_BATCH):
        own = slice(start, start + SCORED_BATCH)
        state = np.ones((len(target[own]), WIDTH + 1), dtype=np.float32)
        state[:, :-1] = sum(inputs[c] * p for c, p in zip(context[:, own], places))
        scores = state @ columns
        wanted = scores[np.arange(len(scores)), target[own]].astype(np.float64)
        # No score is larger than the product of the lengths; this keeps the exponentials in range.
        top = max(0.0, float(np.linalg.norm(state, axis=1).max() * reach) - 60)
        if top:
            scores -= np.float32(top)
        np.exp(scores, out=scores)
        found[own] = wanted - top - np.log((scores @ ones).astype(np.float64))
    return found / np.log(10)


# ---- scores

SCORED = (
    "row long, doc_id long, held_out boolean, n_tokens long, known long, counts double, model double, "
    "rare array<string>, times array<int>"
)


def _scored(batches: Iterator[pa.RecordBatch], data: dict, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    words, row = Vocabulary(data), TaskContext.get().partitionId() << 40
    with np.errstate(divide="ignore"):
        shares = np.where(data["class_size"] > 0, np.log10(data["class_size"]), 0.0)
    own_symbol = data["class_size"] == 0
    for batch, texts in slices(batches):
        found = [tokens(t) for t in texts]
        firsts = np.cumsum([0] + [len(f) for f in found])
        joined = [w for f in found for w in f]
        symbol, number = words.symbols(joined)
        document = np.repeat(np.arange(len(found)), np.diff(firsts))
        logs = np.where(number < 0, 0.0, data["log_counts"][number])
        model = log_probabilities(values, contexts(symbol, firsts, data["end"]), symbol)
        model += np.where(own_symbol[symbol], 0.0, logs - shares[symbol])
        sums = [np.bincount(document, weights=w, minlength=len(found)) for w in (number >= 0, logs, model)]
        at = np.flatnonzero(number < 0)
        cuts = np.searchsorted(at, firsts).tolist()
        unknown = [joined[i] for i in at.tolist()]
        rare = [Counter(unknown[a:b]) for a, b in zip(cuts, cuts[1:])]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(row + np.arange(len(found))),
                batch.column(0),
                batch.column(1),
                pa.array(np.diff(firsts), pa.int64()),
                pa.array(sums[0].astype(np.int64)),
                pa.array(sums[1]),
                pa.array(sums[2]),
                pa.array([[w.decode() for w in r] for r in rare], pa.list_(pa.string())),
                pa.array([list(r.values()) for r in rare], pa.list_(pa.int32())),
            ],
            names=["row", "doc_id", "held_out", "n_tokens", "known", "counts", "model", "rare", "times"],
        )
        row += len(found)


def score(docs: DataFrame, known: int = KNOWN) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("fold", fold())
    training = rows.filter(F.col("fold") != HELD_OUT)
    counts = word_counts(training)
    data = vocabulary(counts, known)
    values, words = train(training, data), spark.sparkContext.broadcast(data)
    scored = saved(
        rows.select("doc_id", (F.col("fold") == HELD_OUT).alias("held_out"), "text").mapInArrow(
            lambda batches: _scored(batches, words.value, values), SCORED
        )
    )
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select(
        "row", F.col("r.rare").alias("word"), F.col("r.times").alias("times")
    )
    added = (
        rare.join(counts, "word")
        .groupBy("row")
        .agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_counts"))
    )
    base = F.lit(float(np.log10(data["tokens"] + data["words"] + 1)))
    more = F.coalesce("more_counts", F.lit(0.0))
    return scored.drop("rare", "times").join(added, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(data["tokens"]).cast("long").alias("train_tokens"),
        (F.col("counts") + more - F.col("n_tokens") * base).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"))
