"""Metric roll-ups: evaluation summary, generation metrics, token accuracy, counts.

All of them are one aggregation each (``rollup`` = ``GROUPING SETS ((), (key))``), so
Spark's partial + final aggregation does the map-side combine and a dominant language
never lands in a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.arrays import shift_compare
from ..functions.locale import lang_of
from ..functions.numeric import format_metric, py_round4, ratio
from .ranking import with_row_id


def _exact_sum(df: DataFrame, m: str):
    """Scores have four decimal places; summed as decimals, the total does not depend on the
    order in which tasks add up."""
    if df.schema[m].dataType.typeName() in ("double", "float"):
        return F.sum(F.col(m).cast("decimal(20,4)")).cast("double")
    return F.sum(m)


def eval_summary(df: DataFrame, by: str = "expected_lang", require_rouge: bool = True) -> DataFrame:
    """Global and per-group means of the metric columns present.

    Output: ``<by>`` (NULL on the overall row), ``is_overall`` (0/1), ``n``, and for each
    metric ``m``: ``m_sum``, ``m_null`` (rows without a score, e.g. without a gold answer)
    and the unrounded mean ``m`` over the scored rows. No rows -> no output; with
    ``require_rouge`` (the toolkit's rule) a table without ``rouge1_f1`` yields nothing.
    """
    metrics = [m for m in K.EVAL_METRICS if m in df.columns]
    if require_rouge and "rouge1_f1" not in df.columns:
        return df.sparkSession.createDataFrame([], f"{by} string, is_overall int, n long")
    aggs = [F.count(F.lit(1)).alias("n")]
    for m in metrics:
        aggs += [_exact_sum(df, m).alias(f"{m}_sum"), F.count(m).alias(f"_{m}_n")]
    grouped = df.rollup(by).agg(*aggs, F.grouping(by).cast("int").alias("is_overall"))
    out = [by, "is_overall", "n"]
    for m in metrics:
        out += [f"{m}_sum", (F.col("n") - F.col(f"_{m}_n")).alias(f"{m}_null"), ratio(f"{m}_sum", f"_{m}_n").alias(m)]
    return grouped.select(*out)


def gen_metrics(df: DataFrame, prefix: str = "eval", subset_col: str = "subset",
                metrics=("exact_match", "rouge1", "rougeL", "score")) -> DataFrame:
    """Generation metrics in long form ``(metric, lang, n, value)``.

    ``value`` is the mean of the per-row values that are not NULL (``n`` of them), rounded
    to 4 places the Python way; names are ``<prefix>_gen_<metric>`` overall and
    ``<prefix>_gen_<metric>_<lang>`` per language (prefix before ``_``, ``unknown`` for an
    empty subset). The overall block also has ``<prefix>_gen_n_samples``, the number of
    rows. An empty input gives 0.0 means and 0 samples. The input is read once.
    """
    present = [m for m in metrics if m in df.columns]
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for m in present:
        aggs += [_exact_sum(df, m).cast("double").alias(f"s_{m}"), F.count(m).alias(f"n_{m}")]
    grouped = df.withColumn("_lang", lang_of(subset_col)).rollup("_lang").agg(*aggs, F.grouping("_lang").alias("_g"))
    # (metric, total, n) rows of each group; the total row also gives the number of rows.
    items = [F.struct(F.lit(m).alias("m"), F.col(f"s_{m}").alias("total"), F.col(f"n_{m}").alias("n")) for m in present]
    rows = F.struct(F.lit("n_samples").alias("m"), F.lit(None).cast("double").alias("total"), F.col("_rows").alias("n"))
    long = grouped.select("_lang", "_g", F.explode(F.when(F.col("_g") == 1, F.array(*items, rows))
                                                    .otherwise(F.array(*items))).alias("i")).select("_lang", "_g", "i.*")
    name = F.concat(F.lit(f"{prefix}_gen_"), "m")
    found = long.select(F.when(F.col("_g") == 1, name).otherwise(F.concat(name, F.lit("_"), "_lang")).alias("metric"),
                        F.when(F.col("_g") == 0, F.col("_lang")).alias("lang"), "n",
                        F.when(F.col("m") == "n_samples", F.col("n").cast("double"))
                        .otherwise(ratio("total", "n")).alias("value"))
    # A rollup of no rows has no total row; the overall names are always reported.
    names = df.sparkSession.createDataFrame([(f"{prefix}_gen_{m}",) for m in [*present, "n_samples"]], "_name string")
    overall = F.col("lang").isNull() & (F.col("metric") == F.col("_name"))
    full = found.join(F.broadcast(names), overall, "full_outer")      # at most five names
    return full.select(F.coalesce("metric", "_name").alias("metric"), "lang",
                       F.coalesce("n", F.lit(0).cast("long")).alias("n"),
                       py_round4(F.when(F.col("metric").isNull(), F.lit(0.0)).otherwise(F.col("value"))).alias("value"))


def token_counts(df: DataFrame, preds: str = "pred_ids", labels: str = "labels",
                 ignore: int = K.IGNORE_INDEX) -> DataFrame:
    """Per-sequence (correct, total) after the causal shift: prediction ``t`` against
    label ``t+1``, labels equal to ``ignore`` skipped."""
    sc = shift_compare(preds, labels, ignore)
    return df.withColumn("_sc", sc).withColumn("correct", F.col("_sc.correct")) \
        .withColumn("total", F.col("_sc.total")).drop("_sc")


def token_positions_to_sequences(df: DataFrame, seq: str = "seq_id", pos: str = "pos",
                                 label: str = "label_id", pred: str = "pred_id",
                                 keep=("step", "subset")) -> DataFrame:
    """Long (one row per token position) -> one row per sequence with ordered arrays.

    A sequence is bounded by ``max_seq_length``, so collecting it is a bounded group.
    """
    agg = [F.array_sort(F.collect_list(F.struct(pos, pred, label))).alias("_t")]
    agg += [F.first(k).alias(k) for k in keep]
    return (df.groupBy(seq).agg(*agg)
            .select(seq, *keep,
                    F.transform("_t", lambda x: x[pred]).alias("pred_ids"),
                    F.transform("_t", lambda x: x[label]).alias("labels")))


def token_accuracy(df: DataFrame, subset_col: str = "subset", every: int | None = None,
                   step_col: str = "step") -> DataFrame:
    """Micro-averaged token accuracy, overall and per language, from per-sequence
    ``correct``/``total`` counts (see ``token_counts``).

    With ``every`` the counts reset at every log: one value per window
    ``floor(step / every)``. Output ``(log_window, lang, correct, total, accuracy)``; the
    overall row has ``lang`` NULL. Groups without a scored token emit nothing.
    """
    x = df.where(F.col("total") > 0).withColumn("_lang", lang_of(subset_col))
    if every:
        x = x.withColumn("log_window", F.floor(F.col(step_col) / F.lit(every)).cast("long"))
        g = x.groupBy("log_window", F.col("_lang").alias("lang")).agg(F.sum("correct").alias("correct"),
                                                                  F.sum("total").alias("total"))
        overall = g.groupBy("log_window").agg(F.sum("correct").alias("correct"), F.sum("total").alias("total")) \
            .select("log_window", F.lit(None).cast("string").alias("lang"), "correct", "total")
        res = g.unionByName(overall)
    else:
        g = x.rollup("_lang").agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"))
        res = g.select(F.lit(None).cast("long").alias("log_window"), F.col("_lang").alias("lang"), "correct", "total")
    return res.where(F.col("total") > 0).withColumn("accuracy", ratio("correct", "total"))


def lang_counts(df: DataFrame, lang_col: str = "lang") -> DataFrame:
    return df.groupBy(lang_col).agg(F.count(F.lit(1)).alias("n"))


def distinct_first_seen(df: DataFrame, key: str = "lang", order_col: str = "row_id") -> DataFrame:
    """Distinct ``key`` values numbered in order of first appearance, without a one-task
    window: the distinct table may be as long as the key is varied."""
    first = df.groupBy(key).agg(F.min(order_col).alias("first_seen"))
    return with_row_id(first, ["first_seen", key], out="first_rank").select(key, "first_seen", "first_rank")


def format_metrics(df: DataFrame, dp: int = 4, counts=("n",)) -> DataFrame:
    """Display view of a summary: every double column as text with ``dp`` decimals,
    count columns with none."""
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "double":
            out.append(format_metric(f.name, dp).alias(f.name))
        elif f.name in counts:
            out.append(format_metric(F.col(f.name).cast("double"), 0).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
