"""Token-accuracy log windows over a stream.

By step: every micro-batch is aggregated per (window, language), the window being ``floor(step
/ every)``, and its counts are written to its own folder, named by the batch's number; a batch
that runs again after a restart replaces its folder. Counts add up, so no state is kept
between batches and late steps need no watermark.

By event time: a streaming aggregation keeps the windows that are still open in the state
store. The watermark is the latest event time seen before, less the lateness that is allowed;
a window that ends at or before it is written once (append mode, exactly once through the
sink's log) and leaves the state, and rows that come for it later are dropped. What has been
written, what is still open (read from the checkpoint's state) and what was dropped account
for every row that arrived.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.locale import lang_of
from ..functions.numeric import ratio


def log_window_counts(sdf: DataFrame, every: int, step_col: str = "step", subset_col: str = "subset") -> DataFrame:
    x = sdf.where(F.col("total") > 0).withColumn("lang", lang_of(subset_col))
    key = F.floor(F.col(step_col) / F.lit(every)).cast("long").alias("log_window")
    return x.groupBy(key, "lang").agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"))


def stream_log_windows(spark: SparkSession, sdf: DataFrame, every: int, out_dir: str, checkpoint: str) -> DataFrame:
    """Aggregate everything available, then return the counts of every (window, lang), plus
    the all-language row per window."""

    def sink(batch: DataFrame, number: int) -> None:
        log_window_counts(batch, every).write.mode("overwrite").parquet(f"{out_dir}/batch={number}")

    q = (sdf.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    sums = [F.sum("correct").alias("correct"), F.sum("total").alias("total")]
    parts = spark.read.option("basePath", out_dir).parquet(out_dir)
    cur = parts.groupBy("log_window", "lang").agg(*sums)
    overall = cur.groupBy("log_window").agg(*sums) \
        .select("log_window", F.lit(None).cast("string").alias("lang"), "correct", "total")
    return cur.unionByName(overall).withColumn("accuracy", ratio("correct", "total"))


def event_windows(sdf: DataFrame, every: str, lateness: str, ts: str = "ts", subset_col: str = "subset") -> DataFrame:
    """Streaming aggregation per event-time window and language: window_start, window_end, lang,
    correct, total, rows. Rows without an event time belong to no window and are left out."""
    x = sdf.where((F.col("total") > 0) & F.col(ts).isNotNull()).withColumn("lang", lang_of(subset_col))
    x = x.select(F.col(ts).alias("ts"), "lang", "correct", "total").withWatermark("ts", lateness)
    x = x.groupBy(F.window("ts", every).alias("w"), "lang").agg(
        F.sum("correct").alias("correct"), F.sum("total").alias("total"), F.count(F.lit(1)).alias("rows"))
    return x.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "lang", "correct", "total", "rows")


def stream_event_windows(spark: SparkSession, sdf: DataFrame, every: str, lateness: str, out_dir: str, checkpoint: str,
                         ts: str = "ts", subset_col: str = "subset") -> None:
    """Take in everything available, append the windows that the watermark has closed to
    ``out_dir`` (Parquet) and stop. The next call goes on from the checkpoint."""
    q = (event_windows(sdf, every, lateness, ts, subset_col).writeStream.format("parquet").outputMode("append")
         .option("path", out_dir).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def closed_windows(spark: SparkSession, out_dir: str) -> DataFrame:
    """The windows written so far."""
    return spark.read.schema("window_start timestamp, window_end timestamp, lang string, correct long, total long, rows long") \
        .parquet(out_dir)


def open_windows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The windows that the last batch left in the state store, with their counts so far."""
    state = spark.read.format("statestore").load(checkpoint).select(       # cast by place: the state's names repeat
        F.col("key").cast("struct<w: struct<start: timestamp, end: timestamp>, lang: string>").alias("k"),
        F.col("value").cast("struct<correct: long, total: long, rows: long>").alias("v"))
    return state.select(F.col("k.w.start").alias("window_start"), F.col("k.w.end").alias("window_end"), "k.lang", "v.correct", "v.total", "v.rows")


def late_rows(arrived: DataFrame, closed: DataFrame, still_open: DataFrame, ts: str = "ts", subset_col: str = "subset") -> DataFrame:
    """(lang, rows): rows that came after their window was written and were dropped."""
    came = arrived.where((F.col("total") > 0) & F.col(ts).isNotNull())
    came = came.select(lang_of(subset_col).alias("lang"), F.lit(1).cast("long").alias("rows"))
    taken = closed.unionByName(still_open).select("lang", (-F.col("rows")).alias("rows"))
    return came.unionByName(taken).groupBy("lang").agg(F.sum("rows").alias("rows")).where(F.col("rows") != 0)
