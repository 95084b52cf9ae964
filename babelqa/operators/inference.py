"""Batch inference with any predictor, through ``mapInPandas``.

Every task cuts its own rows into batches of ``batch_size`` as they come; nothing is sorted
or shuffled for it. Callers who need dense batch numbers in a given order take
``batching.micro_batches``. Each task builds its predictor once (a model handle per task, not
per row). A failing batch yields empty answers for its rows plus the error text, and the task
goes on (``on_error='blank'``), or fails the job (``'raise'``).

A predictor is ``make_predictor() -> predict(batch: pandas.DataFrame) -> list[str]``. The
result is lazy: an action runs the predictor, so callers that read it twice write it first
(``session.measured``), or run it through ``infer_durable``: there every finished task leaves
its answers in the answer table, and a run after a crash predicts only the rows that have none.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..session import ship_package
from ..sources.files import folders, has_files
from ..sources.reports import write_reported

Predictor = Callable[[pd.DataFrame], list]


def batch_infer(df: DataFrame, make_predictor: Callable[[], Predictor], batch_size: int = K.DEFAULT_INFER_BATCH,
                on_error: str = "blank", answer_col: str = "answer") -> DataFrame:
    """Adds ``batch`` (task number and batch in the task), ``batch_pos`` (place in the batch),
    ``answer`` and ``error`` (NULL when the batch succeeded)."""
    ship_package(df.sparkSession)
    schema = T.StructType(df.schema.fields + [T.StructField("batch", T.LongType()), T.StructField("batch_pos", T.LongType()),
                                              T.StructField(answer_col, T.StringType()), T.StructField("error", T.StringType())])
    cols = df.columns

    def run(it):
        predict, number = make_predictor(), TaskContext.get().partitionId() << 33

        def answer(batch: pd.DataFrame) -> pd.DataFrame:
            out = batch.copy()
            out["batch"], out["batch_pos"] = number, range(len(batch))
            try:
                ans = list(predict(batch))
                if len(ans) != len(batch):
                    raise ValueError(f"predictor returned {len(ans)} answers for {len(batch)} rows")
                out[answer_col], out["error"] = ans, None
            except Exception as e:  # noqa: BLE001 - isolation is the point
                if on_error == "raise":
                    raise
                out[answer_col], out["error"] = "", f"{type(e).__name__}: {e}"
            return out

        held = None
        for pdf in it:
            held = pdf[cols] if held is None else pd.concat([held, pdf[cols]], ignore_index=True)
            while len(held) >= batch_size:
                yield answer(held.iloc[:batch_size].reset_index(drop=True))
                held, number = held.iloc[batch_size:], number + 1
        if held is not None and len(held):
            yield answer(held.reset_index(drop=True))

    return df.mapInPandas(run, schema)


def recorded(column: str) -> Callable[[], Predictor]:
    """A predictor that plays back answers recorded in a column (NULL: empty)."""
    return lambda: lambda batch: batch[column].fillna("").tolist()


def run_folders(spark: SparkSession, path: str) -> list[str]:
    """The folders of the runs that left answers, oldest first."""
    return [f for f in folders(spark, path, "run-") if has_files(spark, f, ".parquet")]


def answers(spark: SparkSession, path: str, key: str = "row_id") -> DataFrame | None:
    """The answer table as far as it is filled: one row per key, a successful answer before a
    failed one, of failed ones the newest; None where no run has left an answer yet."""
    runs = run_folders(spark, path)
    if not runs:
        return None
    parts = [spark.read.parquet(f).withColumn("run", F.lit(k)) for k, f in enumerate(runs)]
    if len(parts) == 1:
        return parts[0].drop("run")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    good = every.where(F.col("error").isNull())
    newest = every.where(F.col("error").isNotNull()).groupBy(key).agg(F.max_by(F.struct(*every.columns), "run").alias("r")).select("r.*")
    return good.unionByName(newest.join(good.select(key), key, "left_anti")).drop("run")


def infer_durable(df: DataFrame, key: str, make_predictor: Callable[[], Predictor], path: str,
                  batch_size: int = K.DEFAULT_INFER_BATCH, on_error: str = "blank", retry_failed: bool = False,
                  answer_col: str = "answer") -> dict[str, int]:
    """Fill the answer table at ``path`` with the rows of ``df`` whose ``key`` it lacks.

    Each run writes into a folder of its own with the committer that publishes a task's file
    when the task ends, so the answers of finished tasks stay when the job, or the driver, dies.
    The next run leaves out their keys (an anti-join). ``df`` must give the same rows under
    the same keys each time; a NULL or repeated key is an error. ``retry_failed`` predicts
    rows again whose batch had failed. Runs on one table must not overlap in time.

    Returns counts of this run, taken in the writing job: rows, batches, failed_rows,
    failed_batches."""
    spark = df.sparkSession
    bad = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(key).isNull()).limit(1).collect()
    if bad:
        raise ValueError(f"{key} is NULL or repeated: {bad[0][key]}")
    done = answers(spark, path, key)
    if done is not None:
        if retry_failed:
            done = done.where(F.col("error").isNull())
        df = df.join(done.select(key), key, "left_anti")
    found = batch_infer(df, make_predictor, batch_size, on_error, answer_col)
    failed, head = F.col("error").isNotNull(), F.col("batch_pos") == 0
    target = f"{path.rstrip('/')}/run-{len(folders(spark, path, 'run-')):06d}"
    return write_reported(found, lambda x: x.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(target), {
        "batches": head, "failed_rows": failed, "failed_batches": head & failed})
