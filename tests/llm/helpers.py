"""Small tables for the tests of the text operators."""

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType())])

# Columns an operator might use itself.
CLASHES = ("size", "hash", "row_key", "shard", "slot", "fp", "kept", "part", "score", "block",
           "target", "copies", "_gone", "quality", "ids", "tags")


def documents(spark, rows, parts=3):
    """rows: (doc_id, text, lang, source)."""
    full = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def with_clashes(df):
    from pyspark.sql import functions as F
    for name in CLASHES[:-1]:
        df = df.withColumn(name, F.lit(name))
    return df.withColumn("tags", F.create_map(F.lit("a"), F.lit(1)))


LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000)) + "."
EDGES = [
    (1, "A plain text. It has two sentences.", "en", "a"),
    (2, None, "en", "a"), (3, "", "fr", None), (4, " \t\n\x0b\x0c\r ", None, None),
    (5, LONG, "en", "b"), (6, "A plain  text.\tIt has two\nsentences.", "en", "b"),
    (7, "x" * 50_000, "de", "b"), (8, "1" * 20_000 + "@" * 300, "de", "b"),
    (1, "A plain text. It has two sentences.", "en", "a"),
    (None, "no id here", "en", "a"), (None, None, None, None),
    (9, "schön   <|endoftext|>   ünd  \n\n ende \U0001f600", "de", "c"),
    (-10, "A plain text. It has two sentences.", "en", "a")]


def edges(spark):
    return with_clashes(documents(spark, EDGES))


def empty(spark):
    return with_clashes(documents(spark, EDGES).limit(0))


def sample(spark, n=400):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(f"doc_id < {n}")
