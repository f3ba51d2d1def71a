"""Small document tables for the edge cases that every operator has to stand."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# As above, with columns whose names the operators use inside.
CLASHING = SCHEMA + ", row_id string, row_text string, row int, node string, code string, kept int, names string"

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))


def documents(spark, rows, clashing: bool = False):
    """Rows of (doc_id, text); the other columns are filled in, some of them with nulls."""
    filled = [
        (i, t, ["en", None, "fr", "xx"][k % 4], ["a", None, "b.example.org"][k % 3], None if t is None else len(t))
        for k, (i, t) in enumerate(rows)
    ]
    if clashing:
        filled = [f + ("1", "2", 3, "4", "5", 6, "7") for f in filled]
    return spark.createDataFrame(filled, CLASHING if clashing else SCHEMA)


EDGES = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "ONE"), (None, "one"), (None, None), (None, "one"),
    (6, "Ärger\x0bim\x0cHaus\r\n\nZeile"), (7, "a <|endoftext|> b"), (8, "\u00a0\u2003x\u0085y"), (9, "\n\n\n"), (10, LONG),
    (11, LONG + " end"), (-5, "😀 " * 50),
]
