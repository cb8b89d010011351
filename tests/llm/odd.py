"""A small documents table with the odd cases, for all operators."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_documents(spark, texts=()):
    """Null in every column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    long = " ".join(f"wörd{k % 700} of" for k in range(30_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 70),
        (1, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 70),
        (2, "the quick brown fox jumps over the lazy dog near the river bank today", None, "a", None),
        (3, None, "en", None, 0),
        (4, "", "en", "b", 0),
        (None, "no id here but words enough to be a text of its own kind", None, None, None),
        (5, long, "de", "b", len(long)),
        (6, "x" * 50_000, "de", "c", 50_000),
        (7, "  \t\n ", "de", "c", 5),
        *[(100 + k, t, "en", "z", len(t)) for k, t in enumerate(texts)],
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("k", "h", "n", "fp", "u", "v", "score", "piece", "__n", "kind", "start", "__hits", "__spans", "__lang", "__gone", "__b", "row", "found", "spans", "own_text", "q_x", "q_lang", "z_both"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame
