"""Document fingerprints by one-permutation MinHash, on Spark expressions only.

A text's five-word shingles (lower-cased, cut at white space; a shorter text is one shingle)
are hashed once. The high bits of a hash choose one of BINS bins, whose smallest hash is kept.
An empty bin takes over the value of a filled one by optimal densification: a fixed sequence
of independent draws per bin, the first filled bin drawn; should TRIES draws all miss, the
draw with the smallest hash among the filled bins. Of each bin's value, hashed once more with
the bin (so that bins sharing a value agree by chance independently), the LOW_BITS low bits
are stored, as one hexadecimal digit.

likeness: the share of equal digits m, corrected for digits that agree by chance,
(m - c) / (1 - c) with c = 2^-LOW_BITS, not below 0.

The next document (ascending doc_id) is found without a global window: the rows are dealt
into ranges of doc_id, each range also gets the rows that start the next one, and the last
range those that start the first.

Defined results: null text is empty. A text without words has an empty fingerprint, like only
another empty one (likeness 1, else 0). Rows without an id come first; rows with equal ids
are ordered by content. A single row is its own next one. An empty table gives no row; other
columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import content_key

SHINGLE_WORDS = 5
BINS = 256
LOW_BITS = 4
TRIES = 12
BIN_SHIFT = 64 - (BINS.bit_length() - 1)


LAST = (1 << BIN_SHIFT) - 1     # the largest hash of a bin marks it empty


def _same_bin(x: Column, y: Column) -> Column:
    return F.shiftrightunsigned(x.bitwiseXOR(y), BIN_SHIFT) == 0


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the fingerprint of a (non-null) text column.

    The hashes are sorted together with the last hash of every bin, so the first of each bin
    is its smallest hash or the mark of an empty one, and the bins come out in order."""
    keep = df.columns
    df = df.withColumn("_w", F.filter(F.split(F.lower(F.col(text)), r"\s+"), lambda w: w != ""))
    df = df.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w))).drop("_w")
    n = F.size("_h")
    five = F.transform(F.sequence(F.lit(0), n - SHINGLE_WORDS),
                       lambda i: F.xxhash64(*(F.get("_h", i + k) for k in range(SHINGLE_WORDS))))
    found = F.when(n >= SHINGLE_WORDS, five).when(n > 0, F.array(F.xxhash64("_h"))).otherwise(F.array().cast("array<bigint>"))
    marks = F.array(*(F.lit(((k - BINS // 2) << BIN_SHIFT) | LAST) for k in range(BINS)))
    df = df.withColumn("_e", n == 0).withColumn("_s", F.sort_array(F.concat(found, marks))).drop("_h")
    df = df.withColumn("_o", F.filter("_s", lambda x, i: (i == 0) | ~_same_bin(x, F.get("_s", i - 1)))).drop("_s")

    def full(x: Column) -> Column:
        return x.bitwiseAND(F.lit(LAST)) != F.lit(LAST)

    def value(own: Column, k: Column) -> Column:
        draws = [F.get("_o", F.xxhash64(k, F.lit(t)).bitwiseAND(F.lit(BINS - 1)).cast("int")) for t in range(TRIES)]
        last = F.array_min(F.transform(F.filter("_o", full), lambda x: F.struct(
            F.xxhash64(k, F.lit(TRIES), F.shiftright(x, BIN_SHIFT)).alias("r"), x.alias("x"))))
        case = F.when(full(own), own)
        for draw in draws:
            case = case.when(full(draw), draw)
        return case.otherwise(last["x"])

    code = F.transform("_o", lambda own, k: F.hex(F.xxhash64(value(own, k), k).bitwiseAND(F.lit((1 << LOW_BITS) - 1))))
    return df.withColumn(out, F.when(F.col("_e"), F.lit("")).otherwise(F.array_join(code, ""))).select(*keep, out)


def likeness(a: str, b: str) -> Column:
    same = F.aggregate(F.zip_with(F.split(F.col(a), ""), F.split(F.col(b), ""), lambda x, y: (x == y).cast("int")),
                       F.lit(0), lambda n, x: n + x)
    chance = 2.0 ** -LOW_BITS
    found = F.greatest(F.lit(0.0), (same / F.lit(BINS) - F.lit(chance)) / F.lit(1 - chance))
    return F.when(F.col(a) == F.col(b), F.lit(1.0)).when((F.col(a) == "") | (F.col(b) == ""), F.lit(0.0)).otherwise(found)


def with_next(df: DataFrame, order: str, tie: str, columns: list[str]) -> DataFrame:
    """df with ``next_<column>`` of the next row by (order, tie), cyclically."""
    ranges = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.coalesce(F.col(order).cast("long"), F.lit(-(1 << 63)).cast("long"))
    df = df.withColumn("_p", place)
    facts = df.agg(F.min("_p").alias("low"), F.percentile_approx(
        "_p", [k / ranges for k in range(1, ranges)], F.lit(100 * ranges)).alias("cuts")).first()
    if facts["low"] is None:
        return df.drop("_p").select("*", *(F.col(c).alias(f"next_{c}") for c in columns))
    cuts = [c for c in sorted(set(facts["cuts"])) if c > facts["low"]]
    bounds = F.array(*map(F.lit, cuts)).cast("array<bigint>")
    df = df.withColumn("_r", F.size(F.filter(bounds, lambda c: c <= F.col("_p"))))
    copies = F.array_compact(F.array(
        F.struct(F.col("_r").alias("range"), F.lit(0).alias("extra")),
        F.when(F.array_contains(bounds, F.col("_p")), F.struct((F.col("_r") - 1).alias("range"), F.lit(1).alias("extra"))),
        F.when(F.col("_p") == F.lit(facts["low"]), F.struct(F.lit(len(cuts)).alias("range"), F.lit(2).alias("extra")))))
    df = df.withColumn("_c", F.explode(copies))
    w = Window.partitionBy("_c.range").orderBy("_c.extra", "_p", tie)
    df = df.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in columns))
    return df.where("_c.extra = 0").drop("_p", "_r", "_c")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. The edited text ends in the start of the next document."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = with_fingerprint(docs, "text", "fingerprint").withColumn("t", content_key("text"))
    docs = with_next(docs, "doc_id", "t", ["text", "fingerprint"])
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next_text", F.lit(1), quarter))
    docs = docs.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", edited.alias("edited"))
    docs = with_fingerprint(docs, "edited", "edited_fingerprint")
    return docs.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
                       likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
                       likeness("fingerprint", "next_fingerprint").alias("near_next"))
