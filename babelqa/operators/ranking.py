"""Dense numbering without a single-task window.

``row_number() OVER (ORDER BY k)`` pulls every row into one task, and
``row_number() OVER (PARTITION BY g ORDER BY k)`` pulls a whole group into one task,
which fails when one group holds a third of the data. Both are replaced by the
classic distributed scheme:

1. range-partition on (group, order) and sort inside each partition - a hot group is
   spread over many partitions;
2. number rows inside each partition (``monotonically_increasing_id`` after the sort
   puts the partition index in the upper bits and the local position in the lower);
3. count rows per (partition, group) - a table with at most ``partitions + groups``
   rows - and turn the counts into start offsets with a window over that small table;
4. join the offsets back (AQE broadcasts the offsets only after measuring them).

Steps 3 and 4 both read the numbered rows. Range bounds are sampled per exchange, so
two evaluations could number rows differently; the numbered rows are therefore written
once as a Parquet table under ``spark.checkpoint.dir`` (shared storage) and read back,
which also cuts the lineage: a lost executor cannot change the numbering. (An eager
``checkpoint()`` would compute the rows twice: once to count, once to save.)

Ties in the order keys must be broken by the caller (add a unique column) for a
deterministic result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import measured

_LOW_BITS = 33  # monotonically_increasing_id: partition id << 33 | record number


def _materialise(df: DataFrame) -> DataFrame:
    return measured(df, "ranked")


def _join_null_safe(left: DataFrame, right: DataFrame, cols) -> DataFrame:
    """Inner join on ``cols`` where NULL matches NULL (a NULL group is still a group)."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in cols else F.col(c) for c in right.columns])
    cond = None
    for c in cols:
        e = left[c].eqNullSafe(r[f"_r_{c}"])
        cond = e if cond is None else cond & e
    return left.join(r, cond).drop(*[f"_r_{c}" for c in cols])


def _cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def rank_within(df: DataFrame, group_cols, order_cols, out: str = "rank",
                num_partitions: int | None = None) -> DataFrame:
    """0-based position of each row inside its group, ordered by ``order_cols``."""
    groups = list(group_cols)
    orders = _cols(order_cols)
    keys = _cols(groups) + orders
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    mid = F.monotonically_increasing_id()
    tagged = (ranged.withColumn("_mid", mid)
              .withColumn("_part", F.shiftright("_mid", _LOW_BITS))
              .withColumn("_local", F.col("_mid").bitwiseAND(F.lit((1 << _LOW_BITS) - 1))))
    tagged = _materialise(tagged)
    # Position of the first row of each (partition, group) inside the partition and the
    # number of rows of the group in that partition.
    counts = tagged.groupBy("_part", *groups).agg(F.min("_local").alias("_first"),
                                                  F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    joined = _join_null_safe(tagged, offsets.select("_part", *groups, "_first", "_before"), ["_part", *groups])
    return joined.withColumn(out, F.col("_before") + F.col("_local") - F.col("_first")) \
        .drop("_mid", "_part", "_local", "_first", "_before")


def with_row_id(df: DataFrame, order_cols, out: str = "row_index",
                num_partitions: int | None = None, key: str | None = None) -> DataFrame:
    """Dense global 0-based index in the order of ``order_cols``.

    With a ``key`` column only ``key`` and the order columns are ranked and materialised;
    the index is then joined back, so wide rows (texts, prompts) are not copied to the
    checkpoint folder. A NULL or repeated key fails the query: the check sits in the index
    column, so no row is dropped or multiplied.
    """
    if key is not None:
        names = [c for c in order_cols if isinstance(c, str)]
        if len(names) != len(order_cols):
            raise ValueError("key= needs order columns given by name")
        narrow = df.select(*dict.fromkeys([key, *names]))
        idx = with_row_id(narrow, order_cols, out, num_partitions).groupBy(F.col(key).alias("_key")).agg(
            F.min(out).alias(out), F.count(F.lit(1)).alias("_times"))
        sound = F.col("_key").isNotNull() & (F.col("_times") == 1)
        return df.join(idx, df[key].eqNullSafe(F.col("_key")), "left").withColumn(
            out, F.when(sound, F.col(out)).otherwise(F.raise_error(F.concat(
                F.lit(f"{key} is NULL or repeated: "), F.coalesce(F.col(key).cast("string"), F.lit("NULL"))))
                .cast("long"))).drop("_key", "_times")
    return rank_within(df.withColumn("_all", F.lit(0)), ["_all"], order_cols, out=out,
                       num_partitions=num_partitions).drop("_all")


BROADCAST_SPLITS = 500_000     # rows of a few numbers and a path each


def join_splits(rows: DataFrame, table: DataFrame, how: str = "left") -> DataFrame:
    """Join rows that carry the place of their file split (``_file``, ``_block``) with a written
    table of one row per split, keeping the rows of a task in file order. The table is
    broadcast only up to ``BROADCAST_SPLITS`` rows; beyond, the rows are shuffled by split and
    sorted back."""
    if table.count() <= BROADCAST_SPLITS:
        return rows.join(F.broadcast(table), ["_file", "_block"], how)
    tagged = rows.withColumn("_order", F.monotonically_increasing_id())
    return tagged.join(table, ["_file", "_block"], how).sortWithinPartitions("_file", "_block", "_order").drop("_order")


def split_offsets(counts: DataFrame) -> DataFrame:
    """(_file, _block, ..., n) -> the same with ``_before``, the rows of all splits before. The
    window runs over one row per split."""
    w = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("n").over(w), F.lit(0)).cast("long"))


def file_places(df: DataFrame) -> DataFrame:
    """df, as read from files, with the place of each row: ``_file``, ``_block`` (start of its
    split) and ``_mid`` (task and place in the task)."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                     F.monotonically_increasing_id().alias("_mid"))


def split_counts(placed: DataFrame) -> DataFrame:
    """Rows and first ``_mid`` of each split, in one narrow pass."""
    return placed.groupBy("_file", "_block").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("n"))


def numbered_in_splits(placed: DataFrame, offsets: DataFrame, out: str) -> DataFrame:
    """``out`` = rows of all splits before + place in the split. ``placed`` must come from a scan
    through narrow steps. Should the files be split otherwise than when they were counted,
    places leave the counted range and the query fails."""
    x = join_splits(placed, offsets.select("_file", "_block", "_first", F.col("n").alias("_n"), "_before"))
    local = F.col("_mid") - F.col("_first")
    sound = (local >= 0) & (local < F.col("_n"))
    return x.withColumn(out, F.when(sound, F.col("_before") + local).otherwise(
        F.raise_error(F.lit("the files were split anew while their rows were numbered")).cast("long"))) \
        .drop("_file", "_block", "_mid", "_first", "_n", "_before")


def in_file_order(df: DataFrame, out: str = "row_id") -> DataFrame:
    """df, as read from files (filters and projections allowed), with a dense 0-based number in
    the order of files (by path) and of the rows in each. Two narrow passes: rows are counted
    per split, then shifted by the rows of the splits before; no row is shuffled or sorted."""
    placed = file_places(df)
    return numbered_in_splits(placed, measured(split_offsets(split_counts(placed)), "splits"), out)


def running_max(df: DataFrame, order_col: str, value_col: str, out: str = "running_max",
                num_partitions: int | None = None) -> DataFrame:
    """``max(value) OVER (ORDER BY order_col ROWS UNBOUNDED PRECEDING)`` without a
    single-task window: running max inside each range partition, combined with the
    maximum of all earlier partitions (a table with one row per partition)."""
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = df.repartitionByRange(n, order_col).sortWithinPartitions(order_col)
    tagged = _materialise(ranged.withColumn("_part", F.spark_partition_id()))
    local = tagged.withColumn("_lmax", F.max(value_col).over(
        Window.partitionBy("_part").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)))
    parts = tagged.groupBy("_part").agg(F.max(value_col).alias("_pmax"))
    prev = parts.withColumn("_prev", F.max("_pmax").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("_part", "_prev")
    return local.join(prev, "_part").withColumn(
        out, F.greatest(F.col("_lmax"), F.col("_prev"))).drop("_part", "_lmax", "_prev")


def hash_bucket(hash_col, prefix_chars: int = 4) -> Column:
    """Order-preserving bucket of a fixed-width lower-case hex digest."""
    return F.conv(F.substring(hash_col, 1, prefix_chars), 16, 10).cast("int")


def rank_by_hash(df: DataFrame, group_cols, hash_col: str, tie_cols=(), out: str = "rank",
                 prefix_chars: int = 4, below: Column | None = None) -> DataFrame:
    """0-based position inside each group in ``(hash_col, *tie_cols)`` order, for a
    ``hash_col`` that is a fixed-width lower-case hex digest (``md5``).

    A digest's first ``prefix_chars`` hex digits are an order-preserving bucket holding
    about ``16**-prefix_chars`` of every group, so a group of billions of rows is spread
    over 65,536 small windows. rank = rows of the group in earlier buckets (a window
    over the bucket-count table) + position inside the bucket. The bucket is a pure
    function of the row: any re-evaluation or retry gives the same ranks. ``df`` is read
    twice, so callers pass a written table. ``below`` (a column) keeps only ranks under it;
    whole buckets beyond it are left out before the window.
    """
    groups = list(group_cols)
    x = df.withColumn("_b", hash_bucket(hash_col, prefix_chars))
    counts = x.groupBy(*groups, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = measured(counts.select(*groups, "_b", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_before")),
                       "buckets")
    x = _join_null_safe(x, offsets, [*groups, "_b"])
    if below is not None:
        x = x.where(F.col("_before") < below)
    local = F.row_number().over(Window.partitionBy(*groups, "_b").orderBy(hash_col, *tie_cols)) - 1
    x = x.withColumn(out, F.col("_before") + local)
    return (x if below is None else x.where(F.col(out) < below)).drop("_b", "_before")
