"""Rows for the operator tests: nulls, empties, ties, repeated rows, clashing columns."""

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, key int, size string, fp string, a int, label int"


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source); other columns clash with the operators' own."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 1, 7, "x", "y", 3, 0) for r in rows]
    return spark.createDataFrame(full, DOC)
