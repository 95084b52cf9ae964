"""Small documents shared by the tests of this folder."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])
# names that the operators use inside
CLASHING = ["t", "node", "key", "row", "size", "_d", "_t", "h", "p", "score", "packed", "places", "turns", "_w"]


def words(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}é" if rng.random() < 0.1 else f"word{rng.randrange(vocabulary)}" for _ in range(n)]


def documents(spark, texts, ids=None, clash=False, langs=None):
    rows = [(k if ids is None else ids[k], x, None if langs is None else langs[k], f"s{k % 3}" if k % 4 else None,
             None if x is None else len(x)) for k, x in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    if clash:
        from pyspark.sql import functions as F
        df = df.select("*", *(F.lit(f"x{c}").alias(c) for c in CLASHING))
    return df


def odd_texts():
    """Null, empty, blank, one character, marks, long, repeated."""
    long = " ".join(words(1, 30_000, 5000))
    return [None, "", " \n\t", "x", "a b", "<|endoftext|> \\ ### </turn>", long, long, "ü" * 900, "same text " * 60,
            "same text " * 60, " ".join(words(2, 300))]
