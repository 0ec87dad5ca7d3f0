from pyspark.sql import types as T

DOCUMENT = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)


def documents(spark, rows, extra=()):
    """rows: (doc_id, text) or (doc_id, text, source); extra: names of further columns."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) + tuple("x" for _ in extra) for r in rows]
    schema = T.StructType([*DOCUMENT.fields, *[T.StructField(n, T.StringType()) for n in extra]])
    return spark.createDataFrame(full, schema)


#: Columns with names that the operators use themselves.
CLASHES = ("row", "node", "key", "size", "words", "label", "score", "kept", "item", "length", "start", "address", "n", "slot", "block")
