"""Sampling: stratified by language, uniform, head, inspection sample, shard unions.

Random choices order rows by ``md5(seed | ... | row key)``: reproducible, identical in
any engine that has ``md5``, and independent of partitioning or retries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.locale import lang_of
from ..session import measured
from .ranking import _join_null_safe, hash_bucket


def md5_order(*parts) -> F.Column:
    """``md5(concat_ws('|', parts))``; plain values are literals, Columns are used as is."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def head_n(df: DataFrame, n: int, order_col: str = "row_id") -> DataFrame:
    """First ``n`` rows in ``order_col`` order (a top-k, not a full sort)."""
    return df.orderBy(order_col).limit(n)


def stratified_sample(df: DataFrame, n: int | None, subset_col: str = "subset", order_col: str = "row_id",
                      seed: int = K.DEFAULT_SAMPLE_SEED, keep_null_subset: bool = False) -> DataFrame:
    """Up to ``n`` rows stratified by language (prefix of the subset code).

    L languages in first-appearance order get ``n div L`` rows each, the first
    ``n mod L`` one more; a language with fewer rows gives all of them and the shortfall
    is not redistributed. No subset column -> the first ``n`` rows. ``n`` NULL or <= 0
    -> the input unchanged. The result carries ``lang``.
    """
    if n is None or n <= 0:
        return df
    if subset_col not in df.columns:
        return head_n(df, n, order_col)
    x = df if keep_null_subset else df.where(F.col(subset_col).isNotNull())
    x = x.withColumn("lang", lang_of(subset_col, unknown=None)) \
        .withColumn("_h", md5_order(seed, F.col(order_col))).withColumn("_b", hash_bucket("_h"))
    # One pass counts the hash buckets of every language; all facts come from that table.
    buckets = measured(x.groupBy("lang", "_b").agg(F.count(F.lit(1)).alias("_cnt"),
                                                   F.min(order_col).alias("_seen")), "strata")
    first = buckets.groupBy("lang").agg(F.min("_seen").alias("first_seen"))
    langs = first.select("lang", (F.row_number().over(Window.orderBy("first_seen", "lang")) - 1).alias("first_rank"),
                         F.count(F.lit(1)).over(Window.partitionBy()).alias("_L"))
    quotas = langs.select("lang", (F.floor(F.lit(n).cast("long") / F.col("_L")) +
                                   F.when(F.col("first_rank") < F.pmod(F.lit(n), F.col("_L")), 1).otherwise(0))
                          .cast("long").alias("_quota"))
    upto = Window.partitionBy("lang").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    cuts = _join_null_safe(buckets.withColumn("_before", F.coalesce(F.sum("_cnt").over(upto), F.lit(0))), quotas, ["lang"])
    cuts = measured(cuts.where(F.col("_before") < F.col("_quota")).select("lang", "_b", "_before", "_quota"), "cuts")
    # Only rows of the buckets that reach into the quota are kept and ranked.
    near = _join_null_safe(x, cuts, ["lang", "_b"])
    place = F.row_number().over(Window.partitionBy("lang", "_b").orderBy("_h", order_col)) - 1
    return near.withColumn("_pos", F.col("_before") + place).where(F.col("_pos") < F.col("_quota")) \
        .drop("_h", "_b", "_before", "_quota", "_pos")


def uniform_sample(df: DataFrame, n: int, seed: int, order_col: str = "row_id") -> DataFrame:
    """``min(n, rows)`` rows without replacement, the seed being the training step. The hash
    buckets are counted first, so only rows near the front of the order are ranked."""
    x = df.withColumn("_h", md5_order(seed, F.col(order_col))).withColumn("_b", hash_bucket("_h"))
    counts = x.groupBy("_b").agg(F.count(F.lit(1)).alias("_cnt"))
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)      # at most 65,536 buckets
    cuts = measured(counts.withColumn("_before", F.coalesce(F.sum("_cnt").over(upto), F.lit(0)))
                    .where(F.col("_before") < n).select("_b", "_before"), "cuts")
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_h", order_col)) - 1
    return x.join(cuts, "_b").withColumn("_pos", F.col("_before") + place).where(F.col("_pos") < n) \
        .drop("_h", "_b", "_before", "_pos")


def debug_sample(df: DataFrame, n: int = 5, order_col: str = "row_id") -> DataFrame:
    """The first ``n`` rows kept for inspection (``n <= 0`` -> all of them)."""
    return df if n <= 0 else head_n(df, n, order_col)


def union_shards(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
