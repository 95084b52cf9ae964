"""Lookups: the toolkit's dict lookups and positional zips become joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K


def with_max_len(df: DataFrame, max_lens: DataFrame, key: str = "subset",
                 out: str = "max_new_tokens") -> DataFrame:
    """Per-subset answer-length cap. An unknown subset is an error, as in the toolkit.

    ``max_lens`` is a preset of a handful of rows (a fixed table), so it is broadcast.
    The unknown-subset check sits in the key column, so it runs whatever is selected.
    """
    lk = F.broadcast(max_lens.select(F.col(key).alias("_k"), F.col(out).alias("_v")))
    j = df.join(lk, df[key] == lk["_k"], "left")
    known = F.when(F.col("_k").isNotNull(), F.col(key)).otherwise(F.raise_error(
        F.concat(F.lit("no max_new_tokens for subset "), F.coalesce(F.col(key), F.lit("NULL")))).cast("string"))
    # the left join alone could be dropped with the cap; the filter keeps it in the plan
    j = j.where(F.col("_k").isNotNull() | known.isNotNull())
    return j.withColumn(out, F.col("_v")).withColumn(key, known).drop("_k", "_v")


def align_answers(questions: DataFrame, answers: DataFrame, key: str = "row_id") -> DataFrame:
    """Positional zip -> equi-join on the row key. Both sides must hold each key once, and
    no NULL key; a key on one side only, a repeated or a NULL key fails the query (the zip
    would have been misaligned). The check lives in the key column, so it cannot be pruned."""
    many = [c for c in answers.columns if c != key]
    # One row per key: the answer of a key that occurs once, and how often it occurs.
    a = answers.groupBy(F.col(key).alias("_akey")).agg(
        F.count(F.lit(1)).alias("_an"), *[F.first(c).alias(c) for c in many])
    q = questions.groupBy(F.col(key).alias("_qkey")).agg(F.count(F.lit(1)).alias("_qn"))
    j = questions.join(q, questions[key].eqNullSafe(q["_qkey"]), "left")
    j = j.join(a, j[key].eqNullSafe(a["_akey"]), "full_outer")
    sound = F.col(key).isNotNull() & F.col("_akey").isNotNull() & (F.col("_an") == 1) & (F.col("_qn") == 1)
    checked = F.when(sound, F.col(key)).otherwise(F.raise_error(F.lit("answers and questions do not align")).cast(
        questions.schema[key].dataType))
    return j.withColumn(key, checked).drop("_akey", "_an", "_qkey", "_qn")


def params_map(params: dict) -> F.Column:
    """A literal ``map<string,string>`` of decoding parameters (JSON-style values)."""
    import json
    items = []
    for k, v in params.items():
        items += [F.lit(k), F.lit(v if isinstance(v, str) else json.dumps(v))]
    return F.create_map(*items) if items else F.create_map().cast("map<string,string>")


def merge_params(base, overrides) -> F.Column:
    """``{**base, **overrides}``: keys of ``overrides`` win. Keys are dropped from
    ``base`` first, so no duplicate-key policy is needed."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(overrides), k)), overrides)


def decode_params(df: DataFrame, max_lens: DataFrame, base: dict | None = None,
                  key: str = "subset") -> DataFrame:
    """Per-row decoding parameters: the file's params overridden by the subset's
    ``max_new_tokens``."""
    base = K.GENERATION_PARAMS if base is None else base
    x = with_max_len(df, max_lens, key)
    over = F.create_map(F.lit("max_new_tokens"), F.col("max_new_tokens").cast("string"))
    return x.withColumn("params", merge_params(params_map(base), over))
