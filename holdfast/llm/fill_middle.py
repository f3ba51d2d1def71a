"""Fill-in-middle transformation (operator 11).

A pyarrow.compute pipeline, batch by batch. Texts are split into units (lines with their line feed) as
list arrays; the lists are flattened with the index of the parent row, a unit's ordinal is its place
less the start of its row, and its role (prefix, middle, suffix) follows from comparing the ordinal
with the two cuts of the row. The units of one role are filtered out, put back into a list per row and
joined to a piece; ``binary_join_element_wise`` sets the pieces between the marks.

Cuts and form come from a hash of seed and document id, so a task that runs again, on whatever
partition, makes the same rows. Nothing is shuffled; a batch is taken in slices of ``SLICE_BYTES`` of
text, and a longer text is a slice of its own.

Defined results: null and empty texts, and texts that hold one of the marks, stay as they are (form
``plain``); a null id counts as an empty one; repeated rows give the same row each; other columns of
the input are passed through, those named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.tables import plain_text, read_table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, FIM_PERCENT, SPM_PERCENT = 7, 100, 50
SLICE_BYTES = 4 << 20

COLUMNS = "n long, form string, prefix_chars long, middle_chars long, output string"
_NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit draws of a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def units(texts: pa.Array) -> pa.Array:
    """The lines of every text, each with its line feed: a list array."""
    parts = pc.split_pattern(texts, "\n")
    offsets = parts.offsets.to_numpy()
    row, flat = pc.list_parent_indices(parts), pc.list_flatten(parts)
    last = np.zeros(len(flat), dtype=bool)
    last[offsets[1:] - 1] = True
    ends = pc.if_else(pa.array(last), pa.scalar("", flat.type), pa.scalar("\n", flat.type))
    lines = pc.binary_join_element_wise(flat, ends, pa.scalar("", flat.type))
    # Behind a line feed at the end there is no further unit.
    real = pc.not_equal(lines, "")
    return rebuilt(lines.filter(real), row.filter(real), len(texts))


def rebuilt(values: pa.Array, row: pa.Array, rows: int) -> pa.Array:
    """A list per row of the values that belong to it, in order."""
    offsets = np.zeros(rows + 1, dtype=np.int32)
    np.cumsum(np.bincount(row.to_numpy(), minlength=rows), out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def pieces(lists: pa.Array, first: np.ndarray, second: np.ndarray) -> list[pa.Array]:
    """Prefix, middle and suffix of every row, cut after ``first`` and ``second`` units."""
    row, flat = pc.list_parent_indices(lists), pc.list_flatten(lists)
    parents = row.to_numpy()
    ordinal = np.arange(len(flat)) - lists.offsets.to_numpy()[parents]
    role = (ordinal >= first[parents]).astype(np.int8) + (ordinal >= second[parents])
    found = []
    for k in range(3):
        own = pa.array(role == k)
        found.append(pc.binary_join(rebuilt(flat.filter(own), row.filter(own), len(lists)), ""))
    return found


def transformed(texts: pa.Array, hashes: list[np.ndarray], fim_percent: int, spm_percent: int) -> list[pa.Array]:
    """The columns of ``COLUMNS`` for a slice of texts without nulls."""
    lists = units(texts)
    n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    one, other = hashes[0] % (n + 1), hashes[1] % (n + 1)
    prefix, middle, suffix = pieces(lists, np.minimum(one, other), np.maximum(one, other))
    marked = pc.or_(pc.or_(pc.match_substring(texts, PREFIX), pc.match_substring(texts, SUFFIX)), pc.match_substring(texts, MIDDLE))
    plain = pc.or_(pc.or_(marked, pc.equal(texts, "")), pa.array(hashes[2] % 100 >= fim_percent))
    spm = pa.array(hashes[3] % 100 < spm_percent)
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    output = pc.if_else(
        plain,
        texts,
        pc.if_else(
            spm,
            pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, ""),
            pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, ""),
        ),
    )
    none = pa.scalar(None, pa.int64())
    chars = [pc.if_else(plain, none, pc.utf8_length(p).cast(pa.int64())) for p in (prefix, middle)]
    return [pa.array(n), form, *chars, output]


def _transformed(batches: Iterator[pa.RecordBatch], fim_percent: int, spm_percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(sizes) - sizes) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
        for low, high in zip(cuts, cuts[1:]):
            own = batch.slice(low, high - low)
            # A copy of its own: offsets of a slice do not start at 0.
            texts = pa.concat_arrays([own.column(1).cast(pa.string())])
            hashes = [own.column(k).to_numpy() for k in range(2, 6)]
            found = transformed(texts, hashes, fim_percent, spm_percent)
            yield pa.RecordBatch.from_arrays([own.column(0), *found], names=["row", *_NAMES])


def fill_in_middle(
    docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT
) -> DataFrame:
    """``docs`` without ``text``, with ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``."""
    others = [c for c in docs.columns if c.lower() != "text" and c.lower() not in _NAMES]
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"),
        plain_text().alias("text"),
        *(h.alias(f"h{k}") for k, h in enumerate(draws(F.col("doc_id"), seed))),
    )
    row = rows.schema["row"].dataType.simpleString()
    found = rows.mapInArrow(lambda b: _transformed(b, fim_percent, spm_percent), f"row {row}, {COLUMNS}")
    return found.select("row.*", *_NAMES)


def restored(form: Column, output: Column) -> Column:
    """The exact text, rebuilt from form and output: no mark is in a text that was cut."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    prefix = F.when(form == "psm", parts[1]).otherwise(parts[2])
    suffix = F.when(form == "psm", parts[2]).otherwise(parts[1])
    return F.when(form == "plain", output).otherwise(F.concat(prefix, parts[3], suffix))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return found.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("form"), F.col("output")).cast("binary"), 256).alias("restored_sha256"),
    )


OP11_SQL = """
WITH texts AS (
    SELECT doc_id, COALESCE(text, '') AS text, sha256('7:' || COALESCE(doc_id::VARCHAR, '')) AS digest FROM documents
), hashed AS (
    SELECT *, string_split(text, chr(10)) AS parts,
        ('0x' || substr(digest, 1, 8))::BIGINT AS h1, ('0x' || substr(digest, 9, 8))::BIGINT AS h2,
        ('0x' || substr(digest, 17, 8))::BIGINT AS h3, ('0x' || substr(digest, 25, 8))::BIGINT AS h4
    FROM texts
), counted AS (
    SELECT *, (len(parts) - CASE WHEN parts[len(parts)] = '' THEN 1 ELSE 0 END)::BIGINT AS n FROM hashed
), cut AS (
    SELECT *, LEAST(h1 % (n + 1), h2 % (n + 1)) AS lo, GREATEST(h1 % (n + 1), h2 % (n + 1)) AS hi,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100
            THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM counted
), heads AS (
    SELECT *,
        CASE WHEN lo = 0 THEN '' ELSE array_to_string(parts[1:lo], chr(10)) || CASE WHEN lo < len(parts) THEN chr(10) ELSE '' END END AS prefix,
        CASE WHEN hi = 0 THEN '' ELSE array_to_string(parts[1:hi], chr(10)) || CASE WHEN hi < len(parts) THEN chr(10) ELSE '' END END AS both_parts
    FROM cut
), pieces AS (
    SELECT *, substr(both_parts, length(prefix) + 1) AS middle, substr(text, length(both_parts) + 1) AS suffix FROM heads
), written AS (
    SELECT *, CASE form WHEN 'plain' THEN text
        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output
    FROM pieces
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars, sha256(output) AS output_sha256,
    sha256(CASE WHEN form = 'plain' THEN output ELSE prefix || middle || suffix END) AS restored_sha256
FROM written
"""
