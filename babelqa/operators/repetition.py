"""Degenerate-repetition detection and cleanup on token arrays.

Rows are hash-partitioned by their key once; a row's n-grams are then generated inside
its task and every later window and aggregate is keyed by (key, ...), so Spark reuses
that partitioning and the whole operator costs a single shuffle of the input rows. A
row is bounded by its own length, so a long text is one bounded group.

Grams are compared as strings: tokens joined with ``gram_sep``. That is exact when the
separator cannot occur inside a token - ``" "`` for whitespace-split words, ``""`` for
lossless tokens (each of them after the first starts with whitespace and ends with
non-whitespace, so the joined text splits back uniquely). ``gram_sep=None`` compares
the token arrays themselves, for arbitrary tokens.

Trailing-repetition trimming has a closed form. Dropping the last ``k`` tokens because
that k-gram already occurs in the body can only ever fire for ``k = min_n``: if a longer
tail occurs in the body, so does its ``min_n``-suffix, and smaller ``k`` are tried first.
With ``m = min_n`` and length ``L``, block ``j`` is tokens ``[L-(j+1)m, L-jm)``; it is
removed iff the first occurrence ``p`` of its m-gram in the text ends before the
block starts (``p + m <= L-(j+1)m``). The kept length is ``L - J*m`` with ``J`` the
number of leading removable blocks, and repeating the pass changes nothing more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import lossless_tokens, py_strip


def _by_key(df: DataFrame, key: str) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return df.repartition(n, key)


def _checked(df: DataFrame, key: str):
    """The key, or an error where it is NULL or several rows share it: each row of the input
    counts once in ``_rows``, so no row is dropped or merged with another."""
    return F.when(F.col(key).isNotNull() & (F.col("_rows") == 1), F.col(key)).otherwise(F.raise_error(F.concat(
        F.lit(f"{key} is NULL or repeated: "), F.coalesce(F.col(key).cast("string"), F.lit("NULL"))))
        .cast(df.schema[key].dataType)).alias(key)


def _gram(t, i, n: int, sep: str | None):
    g = F.slice(t, i + 1, n)
    return g if sep is None else F.concat_ws(sep, g)


def first_repeated_ngram(df: DataFrame, tokens: str = "tokens", key: str = "row_id",
                         min_n: int = K.DEFAULT_MIN_N, max_n: int = K.DEFAULT_MAX_N,
                         gram_sep: str | None = " ") -> DataFrame:
    """For each row with a repeated n-gram (``min_n <= n <= max_n``): the longest such
    ``n``, and among its repeated grams the one whose second occurrence comes first;
    returns ``(key, first_start, n)`` with the gram's first start. Overlapping
    occurrences count. Rows without a repeat are absent (the toolkit returns None).

    Every occurrence of a repeated n-gram starts with a repeated ``min_n``-gram. A first
    pass therefore ranks only (key, position, 64-bit hash of the ``min_n``-gram) rows; a
    hash collision can only add a candidate, never drop one. The row's tokens ride on
    its first position row, so the aggregate per key returns the candidate positions
    together with the tokens, and the exact grams of every length are built from them -
    no join back, one exchange in total.
    """
    if min_n < 1 or min_n > max_n:
        return df.sparkSession.createDataFrame([], f"{key} long, first_start int, n int")
    lengths = list(range(min_n, max_n + 1))
    x = _by_key(df.select(key, tokens), key)
    t = F.col(tokens)
    size = F.size(t)
    starts = F.when(size >= min_n, F.sequence(F.lit(0), size - min_n)).otherwise(F.array().cast("array<int>"))
    hashed = x.select(key, F.explode(F.transform(starts, lambda i: F.struct(
        i.alias("pos"), F.xxhash64(_gram(t, i, min_n, gram_sep)).alias("h"),
        F.when(i == 0, t).alias("_t")))).alias("_p")).select(key, "_p.*")
    flagged = hashed.withColumn("_rep", F.count(F.lit(1)).over(Window.partitionBy(key, "h")) > 1)
    per_row = flagged.groupBy(key).agg(F.collect_list(F.when(F.col("_rep"), F.col("pos"))).alias("_cand"),
                                       F.first("_t", ignorenulls=True).alias(tokens),
                                       F.count("_t").alias("_rows")) \
        .where(F.size("_cand") > 0)
    tt = F.col(tokens)
    tsize = F.size(tt)

    def at(i):
        return F.struct(i.alias("pos"), F.array(*[
            F.struct(F.lit(n).alias("n"), F.when(i + n <= tsize, _gram(tt, i, n, gram_sep)).alias("gram"))
            for n in lengths]).alias("gs"))

    stacked = (per_row.select(key, "_rows", F.explode(F.transform("_cand", at)).alias("_p"))
               .select(key, "_rows", "_p.pos", F.explode("_p.gs").alias("_g"))
               .select(key, "_rows", "pos", "_g.n", "_g.gram").where(F.col("gram").isNotNull()))
    w = Window.partitionBy(key, "n", "gram")
    second = (stacked.withColumn("_rn", F.row_number().over(w.orderBy("pos")))
              .withColumn("_first", F.min("pos").over(w))
              .where(F.col("_rn") == 2))
    best = second.groupBy(key).agg(F.max(F.struct(F.col("n"), (-F.col("pos")).alias("neg_pos"),
                                                  F.col("_first").alias("first"))).alias("b"),
                                  F.max("_rows").alias("_rows"))
    return best.select(_checked(df, key), F.col("b.first").alias("first_start"), F.col("b.n").alias("n"))


def _keep_lengths(x: DataFrame, tokens: str, key: str, m: int, sep: str | None, carry=None) -> DataFrame:
    """``(key, n_tokens, n_kept[, _row])`` for rows already partitioned by ``key``.

    Every row yields its m-gram positions (a row shorter than ``m`` yields one marker
    position -1). ``carry`` (a struct of the row's columns) rides on the first position
    only, so the per-key aggregate hands the row back and no join is needed.
    """
    t = F.col(tokens)
    size = F.size(t)
    starts = F.when(size >= m, F.sequence(F.lit(0), size - m)).otherwise(F.array(F.lit(-1)))

    def at(i):
        fields = [i.alias("pos"), F.when(i >= 0, _gram(t, i, m, sep)).alias("g")]
        if carry is not None:
            fields.append(F.when(i <= 0, carry).alias("_row"))
        return F.struct(*fields)

    pos = x.select(key, size.alias("_len"), F.explode(F.transform(starts, at)).alias("_p")).select(
        key, "_len", "_p.*")
    first = pos.withColumn("_first", F.min("pos").over(Window.partitionBy(key, "g")))
    is_block = (F.col("pos") >= 0) & (F.pmod(F.col("_len") - F.col("pos"), F.lit(m)) == 0)
    j = ((F.col("_len") - F.col("pos")) / F.lit(m) - 1).cast("int")
    removable = F.col("_first") + F.lit(m) <= F.col("pos")
    aggs = [F.max("_len").alias("n_tokens"),
            # J = first non-removable block; all removable -> number of blocks.
            F.min(F.when(is_block & ~removable, j)).alias("_stop"),
            F.count(F.when(is_block, F.lit(1))).alias("_nb"),
            F.count(F.when(F.col("pos") <= 0, F.lit(1))).alias("_rows")]
    if carry is not None:
        aggs.append(F.first("_row", ignorenulls=True).alias("_row"))
    out = first.groupBy(key).agg(*aggs)
    kept = (F.col("n_tokens") - F.coalesce(F.col("_stop"), F.col("_nb")) * F.lit(m)).cast("int")
    cols = [_checked(x, key), F.col("n_tokens").cast("int").alias("n_tokens"), kept.alias("n_kept")]
    return out.select(*cols, *(["_row"] if carry is not None else []))


def _check(min_n: int) -> None:
    if min_n < 1:
        raise ValueError("min_n must be >= 1 (0 never terminates in the original loop)")


def trailing_keep_length(df: DataFrame, tokens: str = "tokens", key: str = "row_id",
                         min_n: int = 1, max_n: int = K.DEFAULT_MAX_N, max_passes: int = 1,
                         gram_sep: str | None = " ") -> DataFrame:
    """``(key, n_tokens, n_kept)``: how many leading tokens survive trailing-repetition
    trimming (see the module docstring)."""
    _check(min_n)
    if min_n > max_n or max_passes <= 0:
        return df.select(key, F.size(tokens).alias("n_tokens"), F.size(tokens).alias("n_kept"))
    return _keep_lengths(_by_key(df.select(key, tokens), key), tokens, key, min_n, gram_sep)


def trim_repetition(df: DataFrame, tokens: str = "tokens", key: str = "row_id", min_n: int = 1,
                    max_n: int = K.DEFAULT_MAX_N, max_passes: int = 1, out: str = "trimmed",
                    gram_sep: str | None = " ") -> DataFrame:
    """Token arrays with degenerate trailing repetition removed (other columns kept)."""
    _check(min_n)
    if min_n > max_n or max_passes <= 0:
        return df.withColumn(out, F.col(tokens))
    x = _by_key(df, key)
    others = [c for c in x.columns if c != key]
    keep = _keep_lengths(x, tokens, key, min_n, gram_sep, carry=F.struct(*others))
    return keep.select(key, *[F.col("_row")[c].alias(c) for c in others],
                       F.slice(F.col("_row")[tokens], 1, F.col("n_kept")).alias(out))


def clean_repetition(df: DataFrame, text: str = "text", key: str = "row_id", min_n: int = K.DEFAULT_MIN_N,
                     max_n: int = K.DEFAULT_MAX_N, max_passes: int = K.DEFAULT_MAX_PASSES,
                     out: str = "cleaned") -> DataFrame:
    """Text-level cleanup: lossless tokens (whitespace kept in front of each token),
    trailing-repetition trim, re-join, Python strip."""
    toks = _by_key(df, key).withColumn("_toks", lossless_tokens(text))
    trimmed = trim_repetition(toks, "_toks", key, min_n, max_n, max_passes, out="_kept", gram_sep="")
    return trimmed.withColumn(out, py_strip(F.array_join("_kept", ""))).drop("_toks", "_kept")
