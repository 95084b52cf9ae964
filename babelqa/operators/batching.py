"""Batch planning: language allocation, the stratified batch plan, micro-batches,
per-batch lengths and padding.

The batch plan is computed in closed form instead of by iterating a sampler: draw ``d``
of a language with ``n`` rows is position ``d mod n`` of permutation ``d div n`` of that
language's pool. Each permutation is an md5 order inside (language, cycle), numbered by
the skew-safe ``rank_by_hash``; no row is ever looked up by index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.arrays import pad_to
from ..functions.permute import permuted
from ..session import measured
from .ranking import rank_by_hash, running_max, with_row_id
from .sampling import md5_order



def _all() -> Window:
    """A window over a whole table; only used on the per-language tables below."""
    return Window.partitionBy()


def lang_allocation(counts: DataFrame, effective_batch: int, alpha: float = K.DEFAULT_ALPHA,
                    lang: str = "lang", n: str = "n") -> DataFrame:
    """Slots per language in every effective batch.

    p ~ count^alpha; raw = p * B; slots = floor(raw), zeros raised to 1. If the total
    exceeds B: one pass in descending-count order takes one slot from each language
    that has more than one, until the excess is gone. If it falls short: one more slot
    by descending fractional part of raw. Ties go to the smaller language code.
    ``counts`` has one row per language, so these windows run on a tiny table.
    """
    c = counts.select(F.col(lang).alias("lang"), F.col(n).cast("long").alias("n"))
    c = c.withColumn("_w", F.pow(F.col("n").cast("double"), F.lit(float(alpha))))
    c = c.withColumn("raw", F.col("_w") / F.sum("_w").over(_all()) * F.lit(float(effective_batch)))
    c = c.withColumn("_fl", F.floor("raw").cast("long"))
    c = c.withColumn("_s", F.greatest(F.col("_fl"), F.lit(1)))
    c = c.withColumn("_total", F.sum("_s").over(_all())).withColumn("_L", F.count(F.lit(1)).over(_all()))
    by_count = Window.orderBy(F.desc("n"), "lang").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("_erank", F.sum(F.when(F.col("_s") > 1, 1).otherwise(0)).over(by_count))
    by_frac = Window.orderBy(F.desc(F.col("raw") - F.col("_fl")), "lang")
    c = c.withColumn("_frank", F.row_number().over(by_frac) - 1)
    excess = F.col("_total") - F.lit(effective_batch)
    deficit = F.lit(effective_batch) - F.col("_total")
    take = F.when((excess > 0) & (F.col("_s") > 1) & (F.col("_erank") <= excess), 1).otherwise(0)
    give = F.when(deficit > 0, F.floor(deficit / F.col("_L")) +
                  F.when(F.col("_frank") < F.pmod(deficit, F.col("_L")), 1).otherwise(0)).otherwise(0)
    return c.select("lang", "n", (F.col("_s") - take + give).cast("long").alias("slots"))


def plan_dimensions(alloc: DataFrame, micro: int, accum: int) -> DataFrame:
    """Per language: slots, pool size, number of effective batches (shared) and the
    number of pool cycles the plan needs."""
    a = alloc.withColumn("batches", F.ceil(F.max("n").over(_all()) / F.max("slots").over(_all())).cast("long"))
    a = a.withColumn("cycles", F.ceil(F.col("batches") * F.col("slots") / F.col("n")).cast("long"))
    return a.withColumn("batch_slots", F.sum("slots").over(_all()))


def batch_plan_size(alloc: DataFrame, micro: int, accum: int) -> DataFrame:
    """(effective batches, reported length = batches * accum, real micro-batches)."""
    d = plan_dimensions(alloc, micro, accum)
    return d.agg(F.first("batches").alias("batches"), F.first("batch_slots").alias("batch_slots")).select(
        "batches", (F.col("batches") * accum).alias("reported_len"),
        (F.col("batches") * F.ceil(F.col("batch_slots") / F.lit(micro))).cast("long").alias("real_micro_batches"))


CYCLE_CHUNK = 4096   # pool cycles that one task generates of one row


def batch_plan(df: DataFrame, micro: int, accum: int, alpha: float = K.DEFAULT_ALPHA,
               seed: int = K.DEFAULT_SAMPLE_SEED, lang: str = "lang", key: str = "row_id") -> DataFrame:
    """Language-stratified batch plan.

    Output ``(effective_batch, micro_batch, micro_pos, lang, row_id, cycle)``: every
    effective batch holds ``slots[lang]`` rows of each language, a language's pool is
    used without repeats inside one cycle and reshuffled for the next, each effective
    batch is shuffled and cut into micro-batches of ``micro`` rows (``micro_batch`` is
    numbered globally).

    The input is read twice: once for the counts per language, once for the rows, which are
    repeated once per cycle of their pool and written with their hash. A row's cycles are
    cut into chunks that are spread over the cluster, so a small pool in a long plan does
    not expand in one task.
    """
    x = df.select(F.col(lang).alias("lang"), F.col(key).alias("row_id"))
    alloc = lang_allocation(x.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), micro * accum, alpha)
    dims = plan_dimensions(alloc, micro, accum)
    dims = measured(dims.select("lang", "n", "slots", "batches", "cycles", "batch_slots"), "dims")
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = (x.join(dims, "lang")
            .withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"),
                                                       F.floor((F.col("cycles") - 1) / CYCLE_CHUNK).cast("long"))))
            .repartition(n_parts, "row_id", "_chunk")
            .withColumn("cycle", F.explode(F.sequence(
                F.col("_chunk") * CYCLE_CHUNK,
                F.least((F.col("_chunk") + 1) * CYCLE_CHUNK, F.col("cycles")) - 1))))
    rows = measured(rows.select("row_id", "lang", "n", "slots", "batches", "batch_slots", "cycle", md5_order(
        seed, F.col("lang"), F.col("cycle"), F.col("row_id")).alias("_h")), "cycles")
    # Of the last cycle only the draws that the plan needs are ranked.
    ranked = rank_by_hash(rows, ["lang", "cycle"], "_h", ["row_id"], out="_pos",
                          below=F.col("batches") * F.col("slots") - F.col("cycle") * F.col("n"))
    draws = ranked.withColumn("_d", F.col("cycle") * F.col("n") + F.col("_pos"))
    draws = draws.withColumn("effective_batch", F.floor(F.col("_d") / F.col("slots")).cast("long")) \
        .withColumn("_slot", F.pmod(F.col("_d"), F.col("slots")))
    # Shuffle inside each effective batch (a group of sum(slots) rows).
    wb = Window.partitionBy("effective_batch").orderBy("_bh", "lang", "_slot")
    placed = draws.withColumn("_bh", md5_order(seed, "batch", F.col("effective_batch"), F.col("lang"),
                                               F.col("_slot"))) \
        .withColumn("_p", F.row_number().over(wb) - 1)
    per_batch = F.ceil(F.col("batch_slots") / F.lit(micro)).cast("long")
    return placed.select(
        "effective_batch",
        (F.col("effective_batch") * per_batch + F.floor(F.col("_p") / F.lit(micro))).cast("long")
        .alias("micro_batch"),
        F.pmod(F.col("_p"), F.lit(micro)).cast("long").alias("micro_pos"),
        "lang", "row_id", "cycle",
    )


def plan_index(df: DataFrame, micro: int, accum: int, alpha: float = K.DEFAULT_ALPHA, seed: int = K.DEFAULT_SAMPLE_SEED,
               lang: str = "lang", key: str = "row_id") -> tuple[DataFrame, list]:
    """What ``plan_batches`` needs of a pool, made once: the rows numbered inside their language
    (lang, place, row_id), written, and one fact row per language (lang, n, slots, batches)."""
    x = df.select(F.col(lang).alias("lang"), F.col(key).alias("row_id"))
    x = measured(x.withColumn("_h", md5_order(seed, F.col("row_id"))), "pool")
    alloc = lang_allocation(x.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), micro * accum, alpha)
    facts = plan_dimensions(alloc, micro, accum).select("lang", "n", "slots", "batches").orderBy("lang").collect()
    index = rank_by_hash(x, ["lang"], "_h", ["row_id"], out="place").select("lang", "place", "row_id")
    return measured(index, "pool-index"), facts


def plan_batches(index: DataFrame, facts: list, first: int, last: int, micro: int, seed: int = K.DEFAULT_SAMPLE_SEED) -> DataFrame:
    """Effective batches ``first`` to ``last - 1`` of the plan over a pool, computed alone: batch
    k of any cycle costs its own draws and one join with the index, whatever lies before it.

    Same contract as ``batch_plan`` (other shuffles): draw d of a language is place ``d mod n`` of
    the language's permutation for cycle ``d div n``, and a permutation of the batch's slots
    shuffles the batch. The permutations are keyed (``functions.permute``), so nothing is ranked."""
    if not facts or last <= first:
        return index.sparkSession.createDataFrame([], "effective_batch long, micro_batch long, micro_pos long, lang string, row_id long, cycle long")
    total = sum(f["slots"] for f in facts)
    starts = [sum(f["slots"] for f in facts[:k]) for k in range(len(facts))]
    fact = F.array(*[F.struct(F.lit(f["lang"]).alias("lang"), F.lit(int(f["n"])).cast("long").alias("n"),
                              F.lit(int(f["slots"])).cast("long").alias("slots"), F.lit(s).cast("long").alias("start"))
                     for f, s in zip(facts, starts)])
    slot = F.pmod("id", F.lit(total))
    d = index.sparkSession.range(first * total, last * total).select(
        F.floor(F.col("id") / total).cast("long").alias("effective_batch"), slot.alias("slot"),
        F.element_at(F.filter(fact, lambda f: f["start"] <= slot), -1).alias("f"))
    d = d.withColumn("d", F.col("effective_batch") * F.col("f.slots") + F.col("slot") - F.col("f.start"))
    d = d.withColumn("cycle", F.floor(F.col("d") / F.col("f.n")).cast("long"))
    name = lambda *parts: F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    d = d.select(
        "effective_batch", "cycle", F.col("f.lang").alias("lang"),
        permuted(F.pmod("d", F.col("f.n")), F.col("f.n"), name(seed, F.col("f.lang"), F.col("cycle").cast("string"))).alias("place"),
        permuted(F.col("slot"), F.lit(total), name(seed, "batch", F.col("effective_batch").cast("string"))).alias("p"))
    rows = d.join(index, [d["lang"].eqNullSafe(index["lang"]), d["place"] == index["place"]])
    return rows.select(
        "effective_batch", (F.col("effective_batch") * -(-total // micro) + F.floor(F.col("p") / micro)).cast("long").alias("micro_batch"),
        F.pmod("p", F.lit(micro)).cast("long").alias("micro_pos"), d["lang"], "row_id", "cycle")


def micro_batches(df: DataFrame, size: int, order_col: str = "row_id") -> DataFrame:
    """Rows cut in order into batches of ``size``: ``batch = row_index div size``."""
    x = with_row_id(df, [order_col], key=order_col)
    return x.withColumn("batch", F.floor(F.col("row_index") / F.lit(size)).cast("long"))


def batch_max_len(df: DataFrame, ids: str = "ids", batch: str = "batch",
                  max_seq_len: int = K.DEFAULT_MAX_SEQ_LEN) -> DataFrame:
    """Per batch: longest sequence capped at ``max_seq_len``, and the running maximum
    over batches in batch order (for progress reporting)."""
    per = df.groupBy(batch).agg(F.least(F.max(F.size(ids)), F.lit(max_seq_len)).alias("max_len"))
    return running_max(per, batch, "max_len", out="running_max_len")


def pad_batches(df: DataFrame, ids: str = "ids", labels: str | None = None, batch: str = "batch",
                max_len: int = K.DEFAULT_MAX_SEQ_LEN, pad_id: int | None = 0, eos_id: int | None = None,
                side: str = "left", overflow: str = "error") -> DataFrame:
    """Pad every sequence of a batch to the batch's longest (capped at ``max_len``).

    ids get ``pad_id`` (falling back to ``eos_id``), labels get -100, the attention mask
    is 1 on real tokens and 0 on padding. A sequence longer than the cap fails the query;
    with ``overflow='truncate'`` it keeps its first tokens and ``n_cut`` says how many it
    lost. A batch is a handful of rows, so the window per batch is a tiny group.
    """
    pid = pad_id if pad_id is not None else eos_id
    if pid is None:
        raise ValueError("no pad id and no eos id to fall back to")
    if overflow not in ("error", "truncate"):
        raise ValueError(f"overflow must be 'error' or 'truncate', not {overflow!r}")
    lab = labels or "_labels"
    x = df if labels else df.withColumn(lab, F.col(ids))
    target = F.least(F.max(F.size(ids)).over(Window.partitionBy(batch)), F.lit(max_len))
    x = x.withColumn("_L", target)
    cut_ids = F.slice(ids, 1, F.col("_L"))
    if overflow == "error":
        cut_ids = F.when(F.size(ids) > F.col("_L"), F.raise_error(F.lit("sequence longer than max_len"))
                         .cast("array<int>")).otherwise(cut_ids)
    else:
        x = x.withColumn("n_cut", F.greatest(F.size(ids) - F.col("_L"), F.lit(0)))
    cut_lab = F.slice(lab, 1, F.col("_L"))
    out = x.withColumn("labels_padded", pad_to(cut_lab, F.col("_L"), K.IGNORE_INDEX, side)) \
        .withColumn("attention_mask", pad_to(F.array_repeat(F.lit(1), F.size(cut_ids)), F.col("_L"), 0, side))
    padded = pad_to(cut_ids, F.col("_L"), pid, side)
    # Equal-length check folded into the kept column so the optimizer cannot prune it.
    same = (F.size(padded) == F.size("labels_padded")) & (F.size(padded) == F.size("attention_mask"))
    out = out.withColumn("input_ids", F.when(same, padded).otherwise(
        F.raise_error(F.lit("padded lengths differ")).cast("array<int>")))
    out = out.drop("_L")
    if not labels:
        out = out.drop("_labels")
    return out
