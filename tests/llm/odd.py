"""Odd inputs that every operator must take."""

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, w string, row string, host string, th long"


def doc_rows(texts, source="s"):
    return [(i, t, "en", source, len(t) if t is not None else None, "x", "y", "z", 1) for i, t in enumerate(texts)]


def odd_docs(spark, texts=()):
    """Null and empty texts, null keys, repeated rows, extra columns with clashing names."""
    rows = doc_rows(list(texts))
    rows += [
        (1000, None, None, None, None, None, None, None, None),
        (None, "word " * 60, None, None, None, "x", None, None, None),
        (None, None, None, None, None, None, None, None, None),
        (1001, "", "en", "s", 0, "", "", "", 0),
        (1002, " \n\t\n ", "en", "s", 5, "", "", "", 0),
        (1003, "same row twice", "en", "s", 14, "", "", "", 0),
        (1003, "same row twice", "en", "s", 14, "", "", "", 0),
        (1003, "same key, other text", "en", "s", 20, "", "", "", 0),
    ]
    return spark.createDataFrame(rows, DOC_SCHEMA)
