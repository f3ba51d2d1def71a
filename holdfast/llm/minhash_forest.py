"""Near copies by MinHash and an LSH forest (operator 12).

A document's set holds its distinct ``SHINGLE``-word shingles (words at blanks, ASCII letters lowered).
Two documents are linked when the Jaccard similarity of their sets is ``PERCENT`` or more.

1. *Nodes.* Documents with equal sets are one node, however many there are.
2. *Forest.* A node has ``VALUES`` minima of hash functions. Each of ``TREES`` trees puts the nodes in the
   order of the minima from a place of its own on. Nodes that share a prefix of an order are a region. Its
   depth is adapted: a region of up to ``REGION`` nodes ends at the first minimum; a larger one is cut by
   the next minimum, and so on to ``DEPTH``. What is still larger then is cut into blocks, each with
   the least node of the region. Thus the neighbours with the longest common prefixes meet.
3. *Candidates.* The nodes of a region are compared by their minima. Pairs that agree in ``AGREE`` of
   ``VALUES`` and whose sizes allow the similarity are a graph, of which a region gives a spanning
   forest, never all pairs. Its components over all trees are clusters; a cluster is split no further.
4. *Crowds.* Links inside regions that had to be cut deeper than the first minimum may have been
   missed. All nodes of such regions also go through an exact prefix-filter join on their sets, and the
   pairs it finds between clusters join these.
5. *Links.* Whole sets are compared inside clusters: those of up to ``BLOCK_SHINGLES`` at once, sent once;
   larger ones in blocks, first each block for itself with the cluster's most connected node, then, for
   nodes not yet in one class, each two blocks. Of all links, those that connect classes are kept.

A link is lost only if its sets share no first minimum in any tree (0.2 to the power of 16) or agree in
fewer than ``AGREE`` minima (one in ten million), at the threshold itself; 4 and 5 lose none.

Defined results: null and empty texts and texts without words have an empty set and are linked with
nothing, so their own component; rows with one id and text are one node like all equal sets; null ids
never name a component unless all of its ids are null, and such a row is then kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.components import components
from holdfast.llm.tables import KEYS, keyed, read_table, saved
from holdfast.llm.words import Namer, Words, mix, signed, slices

SHINGLE, PERCENT = 4, 80
VALUES, TREES, DEPTH = 64, 16, 8
REGION, AGREE = 2048, 32
BLOCK_SHINGLES = 1 << 20
# The order of shingles for the prefix filter: counts in hashed buckets over a sample of nodes with about so
# many shingles. Any order gives the same links; a good one keeps frequent shingles out of the prefixes.
ORDER_BITS, ORDER_SAMPLE, ORDER_LEAST = 20, 1 << 22, 16
HOT_TOKEN = 4096
_MOST_PAIRS = 1 << 20

_FACTORS = mix(np.arange(1, VALUES + 1, dtype=np.uint64)) | np.uint64(1)
_SALTS = mix(np.arange(VALUES + 1, 2 * VALUES + 1, dtype=np.uint64))
_FIRST = np.arange(TREES) * (VALUES // TREES)

# ---- sets and minima


def shingle_runs(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of all shingles of a slice, and where each document's start; of few words, the whole sequence."""
    n = np.diff(words.firsts)
    counts = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    cuts = np.concatenate(([0], np.cumsum(counts)))
    document = np.repeat(np.arange(len(n)), counts)
    begin = words.firsts[document] + np.arange(cuts[-1]) - cuts[document]
    return words.stretch(begin, np.minimum(begin + size, words.firsts[document + 1])), cuts


def shingle_sets(words: Words, size: int) -> list[np.ndarray]:
    """Distinct shingles of each document, sorted."""
    names, cuts = shingle_runs(words, size)
    return [np.unique(names[a:b]) for a, b in zip(cuts, cuts[1:])]


def minima(names: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A row of ``VALUES`` minima per document; zeros for empty ones."""
    found = np.zeros((len(cuts) - 1, VALUES), dtype=np.uint64)
    full = np.flatnonzero(np.diff(cuts))
    if len(full):
        for k in range(VALUES):
            found[full, k] = np.minimum.reduceat((names ^ _SALTS[k]) * _FACTORS[k], cuts[full])
    return found


def _sketches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    namer = Namer(lower=True)
    for batch, texts in slices(batches):
        names, cuts = shingle_runs(namer.words(texts), size)
        own = [np.unique(names[a:b]) for a, b in zip(cuts, cuts[1:])]
        values = mix(minima(names, cuts))
        heads = mix(values[:, _FIRST] ^ np.arange(1, TREES + 1, dtype=np.uint64))
        sketch = np.ascontiguousarray(values & np.uint64(255), dtype=np.uint8)
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(i) for i in range(3)),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in own], pa.binary()),
                pa.array([len(s) for s in own], pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * TREES), pa.array(signed(heads).ravel())),
                pa.array([row.tobytes() for row in sketch], pa.binary()),
            ],
            names=[*KEYS, "doc_id", "content", "shingles", "heads", "sketch"],
        )


def sketched(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Row keys, id, digest and size of the set, and its minima."""
    return saved(
        keyed(docs)
        .select(*KEYS, "doc_id", "text")
        .mapInArrow(
            lambda b: _sketches(b, size),
            "row_id long, row_text long, doc_id long, content binary, shingles long, heads array<long>, sketch binary",
        )
    )


def nodes_of(rows: DataFrame) -> DataFrame:
    """One row per distinct set: ``node``, ``content``, ``least`` (id), ``shingles``, ``heads``, ``sketch``, keys of one row."""
    sets = rows.filter("shingles > 0").groupBy("content").agg(
        F.min("doc_id").alias("least"),
        F.first("shingles").alias("shingles"),
        F.first("heads").alias("heads"),
        F.first("sketch").alias("sketch"),
        F.min(F.struct(*KEYS)).alias("key"),
    )
    return saved(sets.select(F.monotonically_increasing_id().alias("node"), "content", "least", "shingles", "heads", "sketch", "key.*"))


# ---- forest


def _counted(rows: DataFrame) -> DataFrame:
    """Rows whose key others share, with the size ``n`` of their region."""
    shared = saved(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).filter("n > 1"))
    return rows.join(shared, "key")


def regions(nodes: DataFrame, region: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """Rows ``key``, ``node``, ``shingles``, ``sketch`` of all regions, and ``node`` of those in crowds."""
    heads = nodes.select("node", F.posexplode("heads").alias("tree", "key"))
    minima_of = nodes.select("node", "shingles", "sketch")
    rows = saved(_counted(heads).join(minima_of, "node"))
    columns = ("key", "node", "shingles", "sketch")
    found = [rows.filter(F.col("n") <= region).select(*columns)]
    large = rows.filter(F.col("n") > region)
    crowds = large.select("node").distinct()
    for level in range(1, depth):
        if large.isEmpty():
            return _union(found), crowds
        place = ((VALUES // TREES) * F.col("tree") + level) % VALUES + 1
        deeper = large.select(F.xxhash64("key", F.col("sketch").substr(place, F.lit(1))).alias("key"), "node", "tree", "shingles", "sketch")
        rows = saved(_counted(deeper))
        found.append(rows.filter(F.col("n") <= region).select(*columns))
        large = rows.filter(F.col("n") > region)
    # Blocks of the regions left over; the least node of a region is in each of its blocks.
    blocks = F.ceil(F.col("n") / region).cast("int")
    found.append(large.withColumn("key", F.xxhash64("key", F.pmod(F.xxhash64("node"), blocks))).select(*columns))
    least = large.filter("node = least").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    found.append(least.withColumn("key", F.xxhash64("key", F.col("block").cast("long"))).select(*columns))
    return _union(found), crowds


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def near(sketch: np.ndarray, shingles: np.ndarray, at: int, others: np.ndarray, percent: int, agree: int) -> np.ndarray:
    """Which of ``others`` agree with row ``at`` in enough minima and may have the similarity by their sizes."""
    small, big = np.minimum(shingles[others], shingles[at]), np.maximum(shingles[others], shingles[at])
    fits = 100 * small >= percent * big
    fits[fits] = (sketch[others[fits]] == sketch[at]).sum(axis=1) >= agree
    return fits


def spanning(node: np.ndarray, shingles: np.ndarray, sketch: np.ndarray, percent: int, agree: int) -> tuple[list, list]:
    """A spanning forest of the candidate pairs of one region, from its middle outwards."""
    left, right = [], []
    if len(node) > 2:
        # The consensus has at each place the value that is most frequent there: the original of edited copies.
        common = np.array([np.bincount(c).argmax() for c in sketch.T], dtype=np.uint8)
        rest = np.argsort(-(sketch == common).sum(axis=1), kind="stable")
    else:
        rest = np.arange(len(node))
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            at = todo.pop(0)
            reached = near(sketch, shingles, at, rest, percent, agree)
            left += [node[at]] * int(reached.sum())
            right += node[rest[reached]].tolist()
            todo += rest[reached].tolist()
            rest = rest[~reached]
    return left, right


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each group, of rows sorted by their first ``keys`` columns."""
    held: list[pa.RecordBatch] = []

    def same(a: pa.RecordBatch, i: int, b: pa.RecordBatch, j: int) -> bool:
        return all(a.column(k)[i].as_py() == b.column(k)[j].as_py() for k in range(keys))

    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        new = np.logical_or.reduce([v[1:] != v[:-1] for v in values])
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            if held and not (low == 0 and same(held[-1], held[-1].num_rows - 1, batch, 0)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def _links(left: list, right: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(rows, VALUES)


def _candidates(batches: Iterator[pa.RecordBatch], percent: int, agree: int) -> Iterator[pa.RecordBatch]:
    left, right = [], []
    for group in _grouped(batches, 1):
        node, shingles = (group.column(c).to_numpy() for c in ("node", "shingles"))
        a, b = spanning(node, shingles, _matrix(group.column("sketch"), len(node)), percent, agree)
        left += a
        right += b
        if len(left) > 1 << 16:
            yield _links(left, right)
            left, right = [], []
    if left:
        yield _links(left, right)


def candidates(found: DataFrame, percent: int, agree: int = AGREE) -> DataFrame:
    """Candidate links ``a``, ``b`` that span each region."""
    return (
        found.repartition("key")
        .sortWithinPartitions("key", "node")
        .mapInArrow(lambda b: _candidates(b, percent, agree), "a long, b long")
    )


# ---- crowds: exact prefix-filter join


def prefix_length(shingles: int, percent: int) -> int:
    return shingles - -(-percent * shingles // 100) + 1


def _buckets(names: np.ndarray) -> np.ndarray:
    return (names >> np.uint64(64 - ORDER_BITS)).astype(np.int64)


def _names(value) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype=np.uint64)


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << ORDER_BITS, dtype=np.int64)
    for batch in batches:
        for value in batch.column(0):
            np.add.at(counts, _buckets(_names(value)), 1)
    found = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], names=["bucket", "n"])


def shingle_order(sets: DataFrame) -> np.ndarray:
    """Counts per bucket, by which shingles are ordered; buckets seldom seen count as zero."""
    total = sets.agg(F.sum("shingles")).first()[0] or 0
    sample = sets.filter(F.pmod(F.xxhash64("node"), F.lit(max(1, -(-total // ORDER_SAMPLE)))) == 0)
    counts = sample.select("names").mapInArrow(_bucket_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    order = np.zeros(1 << ORDER_BITS, dtype=np.int32)
    for row in counts.filter(F.col("n") >= ORDER_LEAST).collect():
        order[row["bucket"]] = min(row["n"], 2**31 - 1)
    return order


def _prefixes(batches: Iterator[pa.RecordBatch], percent: int, order: np.ndarray) -> Iterator[pa.RecordBatch]:
    """First shingles of each node in the order of ``order``, with their places."""
    for batch in batches:
        names, counts, sizes = [np.zeros(0, dtype=np.uint64)], [], []
        for value in batch.column(2):
            own = _names(value)
            # Names are in order already, and stay so where counts are equal.
            first = np.argsort(order[_buckets(own)], kind="stable")[: prefix_length(len(own), percent)]
            names.append(own[first])
            counts.append(len(first))
            sizes.append(len(own))
        which = np.repeat(np.arange(batch.num_rows), counts)
        place = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(signed(np.concatenate(names))),
                batch.column(0).take(pa.array(which, pa.int64())),
                batch.column(1).take(pa.array(which, pa.int64())),
                pa.array(np.array(sizes, dtype=np.int64)[which]),
                pa.array(place),
            ],
            names=["token", "node", "cluster", "shingles", "place"],
        )


def _meetings(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of different clusters that share a token and whose sizes and places leave room for the similarity."""
    left, right, held = [], [], 0

    def pairs():
        both = np.unique(np.sort(np.stack([np.concatenate(left), np.concatenate(right)]), axis=0), axis=1)
        return _links(both[0], both[1])

    for group in _grouped(batches, 3):
        low, high, size, node, cluster, place, home = (
            group.column(c).to_numpy() for c in ("low", "high", "shingles", "node", "cluster", "place", "home")
        )
        # Rows are sorted by size: smaller partners lie before, down to the size that is too small.
        least = np.searchsorted(100 * size, percent * size)
        for x in range(1, len(node)):
            y = np.arange(least[x], x)
            keep = cluster[y] != cluster[x]
            if low[0] != high[0]:
                keep &= home[y] != home[x]
            # At the first shingle that two sets share, all common ones are still to come.
            room = np.minimum(size[x] - place[x], size[y] - place[y])
            y = y[keep & ((100 + percent) * room >= percent * (size[x] + size[y]))]
            if len(y):
                left.append(node[y])
                right.append(np.full(len(y), node[x]))
                held += len(y)
                if held > _MOST_PAIRS:
                    yield pairs()
                    left, right, held = [], [], 0
    if held:
        yield pairs()


def _agreeing(batches: Iterator[pa.RecordBatch], agree: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        one, other = (_matrix(batch.column(k), batch.num_rows) for k in (2, 3))
        keep = pa.array((one == other).sum(axis=1) >= agree)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(keep)


def crowd_links(sets: DataFrame, nodes: DataFrame, percent: int, agree: int = AGREE, hot: int = HOT_TOKEN) -> DataFrame:
    """Candidate links between clusters. ``sets``: ``node``, ``cluster`` and sorted ``names`` of all nodes in crowds."""
    spark = sets.sparkSession
    order = spark.sparkContext.broadcast(shingle_order(sets))
    prefixes = saved(
        sets.select("node", "cluster", "names").mapInArrow(
            lambda b: _prefixes(b, percent, order.value), "token long, node long, cluster long, shingles long, place long"
        )
    )
    shared = saved(
        prefixes.groupBy("token")
        .agg(F.count("*").alias("n"), F.min("cluster").alias("least"), F.max("cluster").alias("most"))
        .filter("least != most")
        .select("token", F.ceil(F.col("n") / hot).cast("int").alias("blocks"))
    )
    home, other = F.col("home"), F.col("other")
    groups = (
        prefixes.join(shared, "token")
        .withColumn("home", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("token", F.least(home, other).alias("low"), F.greatest(home, other).alias("high"), "shingles", "node", "cluster", "place", "home")
    )
    pairs = saved(
        groups.repartition("token", "low", "high")
        .sortWithinPartitions("token", "low", "high", "shingles")
        .mapInArrow(lambda b: _meetings(b, percent), "a long, b long")
        .distinct()
    )
    one = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("x"))
    two = nodes.select(F.col("node").alias("b"), F.col("sketch").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(lambda b: _agreeing(b, agree), "a long, b long")


# ---- links on whole sets


def linked(node: np.ndarray, klass: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[list, list]:
    """Links that connect the classes of one group of sets.

    A row's overlaps with all others come from its shingles' posting lists. Links between two components
    are found once all rows of one of them were looked up, so rows of the largest need not be.
    """
    rows, size = len(node), np.array([len(s) for s in sets], dtype=np.int64)
    _, part = np.unique(klass, return_inverse=True)
    names = np.concatenate(sets)
    order = np.argsort(names, kind="stable")
    owner = np.repeat(np.arange(rows), size)[order]
    new = np.concatenate(([True], names[order][1:] != names[order][:-1]))
    first = np.flatnonzero(new)
    posting = np.empty(len(names), dtype=np.int64)
    posting[order] = np.cumsum(new) - 1
    length = np.diff(np.concatenate((first, [len(names)])))
    starts = np.concatenate(([0], np.cumsum(size)))
    # The row whose shingles are the most common stands in the middle of copies.
    weight = np.add.reduceat(length[posting], starts[:-1]) / size
    left, right = [], []
    members = np.bincount(part)
    for x in np.argsort(-weight, kind="stable").tolist():
        if part[x] == members.argmax() and left:
            continue
        if members[part[x]] == rows:
            break
        own = posting[starts[x] : starts[x + 1]]
        own = own[length[own] > 1]
        n = length[own]
        where = np.repeat(first[own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        common = np.bincount(owner[where], minlength=rows)
        found = np.flatnonzero((100 * common >= percent * (size + size[x] - common)) & (part != part[x]))
        if len(found):
            other, at = np.unique(part[found], return_index=True)
            left += [int(node[x])] * len(at)
            right += node[found[at]].tolist()
            gone = np.isin(part, other)
            members[part[x]] += members[other].sum()
            members[other] = 0
            part[gone] = part[x]
    return left, right


def _verified(batches: Iterator[pa.RecordBatch], keys: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links of groups of rows ``..keys, node, class, names``; a node may be in a group twice."""
    left, right = [], []
    for group in _grouped(batches, keys):
        node, klass = (group.column(c).to_numpy() for c in ("node", "class"))
        _, once = np.unique(node, return_index=True)
        names = group.column("names")
        sets = [_names(names[int(k)]) for k in once]
        if len(once) > 1:
            a, b = linked(node[once], klass[once], sets, percent)
            left += a
            right += b
        if len(left) > 1 << 16:
            yield _links(left, right)
            left, right = [], []
    if left:
        yield _links(left, right)


def cluster_links(sets: DataFrame, edges: DataFrame, percent: int, block: int = BLOCK_SHINGLES) -> DataFrame:
    """Links ``a``, ``b`` inside clusters. ``sets``: ``node``, ``cluster``, ``shingles``, ``names``; ``edges``: candidates."""
    clusters = saved(
        sets.groupBy("cluster")
        .agg(F.sum("shingles").alias("total"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("cluster", F.ceil(F.col("total") / block).alias("blocks"))
    )
    rows = sets.join(clusters, "cluster").select("cluster", "blocks", "node", "names")
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    degree = edges.select(F.col("a").alias("node")).union(edges.select("b")).groupBy("node").agg(F.count("*").alias("degree"))
    many = clusters.filter("blocks > 1")
    middle = (
        sets.select("cluster", "node")
        .join(many, "cluster")
        .join(degree, "node")
        .groupBy("cluster", "blocks")
        .agg(F.max_by("node", F.struct("degree", -F.col("node"))).alias("node"))
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    )
    first = rows.select("cluster", own.alias("block"), "node", F.col("node").alias("class"), "names").unionByName(
        middle.join(sets.select("node", "names"), "node").select("cluster", "block", "node", F.col("node").alias("class"), "names")
    )
    found = saved(
        first.repartition("cluster", "block")
        .sortWithinPartitions("cluster", "block")
        .mapInArrow(lambda b: _verified(b, 2, percent), "a long, b long")
    )
    if many.isEmpty():
        return found
    return found.unionByName(_links_between_blocks(sets.join(many, "cluster"), found, percent, block))


def _links_between_blocks(sets: DataFrame, found: DataFrame, percent: int, block: int) -> DataFrame:
    """Links between classes of the clusters that have several blocks.

    A class larger than a block has blocks of its own, which are not compared with each other;
    the others are dealt out class by class.
    """
    roots = components(found)
    rows = saved(
        sets.select("cluster", "node", "shingles").join(roots, "node", "left").withColumn("class", F.coalesce("root", "node")).drop("root")
    )
    classes = rows.groupBy("cluster", "class").agg(F.sum("shingles").alias("size"))
    open_ = classes.groupBy("cluster").agg(F.count("*").alias("classes"), F.sum(F.when(F.col("size") <= block, F.col("size"))).alias("rest"))
    placed = saved(
        rows.join(classes, ["cluster", "class"])
        .join(open_.filter("classes > 1"), "cluster")
        .withColumn("large", F.when(F.col("size") > block, F.col("class")).otherwise(F.lit(-1)))
        .withColumn(
            "home",
            F.when(F.col("large") >= 0, F.xxhash64("class", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / block)))).otherwise(
                F.xxhash64(F.lit("rest"), F.pmod(F.xxhash64("class"), F.ceil(F.col("rest") / block)))
            ),
        )
        .select("cluster", "node", "class", "large", "home")
    )
    blocks = saved(placed.select("cluster", "large", "home").distinct())
    other = blocks.select("cluster", F.col("large").alias("other_large"), F.col("home").alias("other"))
    meet = blocks.join(other, "cluster").filter((F.col("large") == -1) | (F.col("large") != F.col("other_large")))
    rows = (
        placed.drop("large")
        .join(saved(meet.select("cluster", "home", "other")), ["cluster", "home"])
        .select("cluster", F.least("home", "other").alias("low"), F.greatest("home", "other").alias("high"), "node", "class")
        .join(sets.select("node", "names"), "node")
        .select("cluster", "low", "high", "node", "class", "names")
    )
    return (
        rows.repartition("cluster", "low", "high")
        .sortWithinPartitions("cluster", "low", "high")
        .mapInArrow(lambda b: _verified(b, 3, percent), "a long, b long")
    )


# ---- whole


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    namer = Namer(lower=True)
    for batch, texts in slices(batches):
        own = shingle_sets(namer.words(texts), size)
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(i) for i in range(3)),
                pa.array([len(s) for s in own], pa.int64()),
                pa.array([s.tobytes() for s in own], pa.binary()),
            ],
            names=["node", "cluster", "crowd", "shingles", "names"],
        )


def node_links(
    docs: DataFrame, nodes: DataFrame, size: int, percent: int, region: int, depth: int, block: int, agree: int, hot: int
) -> DataFrame:
    """Links ``a``, ``b`` on whole sets that connect all nodes of a component."""
    found, crowds = regions(nodes, region, depth)
    edges = saved(candidates(found, percent, agree).distinct())
    roots = saved(components(edges))
    crowds = saved(crowds)
    inside = roots.select("node", "root").union(roots.select("root", "root").distinct())
    wanted = saved(
        inside.join(crowds.withColumn("crowd", F.lit(True)), "node", "full").select(
            "node", F.coalesce("root", "node").alias("cluster"), F.coalesce("crowd", F.lit(False)).alias("crowd")
        )
    )
    named = wanted.join(nodes.select("node", *KEYS), "node")
    texts = keyed(docs).select(*KEYS, "text").join(named, list(KEYS)).dropDuplicates(list(KEYS))
    sets = saved(
        texts.select("node", "cluster", "crowd", "text").mapInArrow(
            lambda b: _sets(b, size), "node long, cluster long, crowd boolean, shingles long, names binary"
        )
    )
    if not crowds.isEmpty():
        more = saved(crowd_links(sets.filter("crowd").drop("crowd"), nodes, percent, agree, hot))
        edges = saved(edges.union(more).distinct())
        merged = components(edges)
        sets = saved(sets.drop("cluster").join(merged, "node", "left").withColumn("cluster", F.coalesce("root", "node")).drop("root"))
    return cluster_links(sets.select("node", "cluster", "shingles", "names"), edges, percent, block)


def near_copies(
    docs: DataFrame,
    size: int = SHINGLE,
    percent: int = PERCENT,
    region: int = REGION,
    depth: int = DEPTH,
    block: int = BLOCK_SHINGLES,
    agree: int = AGREE,
    hot: int = HOT_TOKEN,
) -> DataFrame:
    """A row per document: ``doc_id``, ``n_shingles``, ``component_id`` (least id), ``kept``."""
    rows = sketched(docs, size)
    nodes = nodes_of(rows)
    roots = components(node_links(docs, nodes, size, percent, region, depth, block, agree, hot))
    rooted = saved(nodes.select("node", "content", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    named = saved(
        rooted.select("content", "root").join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").drop("root")
    )
    whole = rows.select("doc_id", "shingles", "content").join(named, "content", "left")
    component = F.when(F.col("shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return whole.select("doc_id", F.col("shingles").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    )


def op12_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(read_table(spark, sf_dir, "documents"))
