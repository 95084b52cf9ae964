"""Incremental scoring with Structured Streaming.

Each arriving file of answers is scored as a micro-batch by the batch operator and written to
its own folder, named by the batch's number; a batch that is run again after a restart
replaces its folder, so every row is in the result once. The checkpoint makes a restart resume
where it stopped (the toolkit rewrote its whole CSV after every batch). The dictionary of stems
is kept beside the checkpoint: a micro-batch stems only words that none before it had.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.records import clean_generation
from ..operators.scoring import score_answers


def stream_scoring(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, schema,
                   max_files_per_trigger: int = 1, stems: str | None = None) -> None:
    """Score everything available in ``in_dir`` (Parquet) into ``out_dir`` and stop. ``stems`` is
    the kept dictionary, by default ``<checkpoint>-stems``."""
    kept = stems or f"{checkpoint.rstrip('/')}-stems"
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(in_dir)

    def sink(batch: DataFrame, number: int) -> None:
        score_answers(clean_generation(batch), stems=kept).write.mode("overwrite").parquet(f"{out_dir}/batch={number}")

    q = (src.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def scored(spark: SparkSession, out_dir: str) -> DataFrame:
    """The rows scored so far."""
    return spark.read.option("basePath", out_dir).parquet(out_dir).drop("batch")
