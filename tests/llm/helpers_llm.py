"""Small tables shared by the tests of the training-data operators."""

LONG = " ".join(f"word{i % 997}" for i in range(30_000))

# NULL text, empty, blank, repeated rows, copies by white space, clashing extra columns, very long
EDGE = [
    (5, "a b  c", "en"), (2, "a b\nc", "en"), (9, "a b c", None), (9, "a b c", None), (3, None, "fr"), (4, "", "fr"),
    (7, " ", "de"), (11, LONG, "en"), (12, LONG + " end", "en"), (13, "Ünïcode ß ñ É", None), (None, "a b c", "x"),
    (14, "x" * 5000, "en"), (15, "tab\tand\x0bvt\x1cfs  <|endoftext|> it's", "en"),
]


def edge_docs(spark, rows=EDGE):
    """Documents with extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    for c in ("key", "sha", "row", "n", "fp", "root", "kept", "id", "score", "part", "line", "no", "w", "list"):
        d = d.withColumn(c, F.lit(c))
    return d


def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def rows_of(df):
    return [tuple(r) for r in df.collect()]
