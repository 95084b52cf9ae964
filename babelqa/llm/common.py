"""Helpers shared by the operators of this subpackage: table access, shared scratch
tables and byte views of Arrow columns."""

from __future__ import annotations

import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from babelqa.session import ensure_checkpoint_dir, ship_package

# Rows per Arrow batch handed to a Python worker. A batch of whole documents must fit a
# worker's share of an executor several times over; Spark's default of 10,000 rows does not.
BATCH_ROWS = 256


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Ship the package to the workers and lower the Arrow batch size to ``BATCH_ROWS``."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, its scheme kept."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` once to shared storage and read it back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete a table made by ``written`` that another written table has replaced."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Ask the driver's JVM to collect garbage, which lets Spark delete the shuffle files of
    plans that nothing refers to any more (it would do so every 30 minutes)."""
    gc.collect()
    spark._jvm.System.gc()


BROADCAST_ROWS = 500_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of a few fixed-width columns, marked for broadcast only while it has at
    most ``rows`` rows; a larger one stays for a shuffle join."""
    return F.broadcast(df) if df.count() <= rows else df


def content_key(text) -> Column:
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """docs without the rows whose id and text (by content key) are in ``bad`` (doc_id, t)."""
    bad = small_side(written(bad.select(F.col("doc_id").alias("_d"), F.col("t").alias("_t")).distinct(), "gone"))
    return docs.join(bad, (content_key(docs["text"]) == bad["_t"]) & docs["doc_id"].eqNullSafe(bad["_d"]), "left_anti")


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array and its row offsets (n + 1).
    Null counts as empty. No copy is made of a column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw, at.astype(np.int64)


def batches_of(arrays: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(arrays[f.name], type=f.type) for f in schema], schema=schema)
