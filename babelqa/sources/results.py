"""A result table that takes every batch once.

A batch is written under its identity into a folder of its own and becomes visible when a new
version of the table's list of folders is published. A version is one small file, created
under the next number, which succeeds for one writer only, so a reader sees all of a batch or
nothing, a writer that lost the race looks again, and a repeated batch finds its identity
in the list and writes nothing. ``compact`` puts the rows of many folders into one and
publishes that; who reads meanwhile goes on with the folders of an older version, which
stay until ``clean``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from . import files as FS
from .reports import write_reported

LOG = "_versions"


def _version(spark: SparkSession, path: str) -> tuple[int, dict]:
    """The newest version: its number, and its folders and batches."""
    names = [n for n in FS.files(spark, f"{path}/{LOG}") if n.endswith(".json")]
    if not names:
        return -1, {"folders": [], "batches": []}
    return int(names[-1][:-5]), json.loads(FS.read_text(spark, f"{path}/{LOG}/{names[-1]}"))


def _publish(spark: SparkSession, path: str, number: int, state: dict) -> bool:
    return FS.create(spark, f"{path}/{LOG}/{number:020d}.json", json.dumps(state))


def version(spark: SparkSession, path: str) -> int:
    """The number of the newest version, -1 before the first."""
    return _version(spark, path.rstrip("/"))[0]


def folder_count(spark: SparkSession, path: str) -> int:
    return len(_version(spark, path.rstrip("/"))[1]["folders"])


def write_batch(batch: DataFrame, path: str, batch_id: str, columns=None, keep_empty: bool = True) -> int | None:
    """Add a batch under its identity and return its rows; None (and nothing written) if the
    table has it. Without ``keep_empty`` a batch of no rows adds no folder after the first."""
    spark, path = batch.sparkSession, path.rstrip("/")
    if batch_id in _version(spark, path)[1]["batches"]:
        return None
    folder = f"rows-{uuid.uuid4().hex}"
    rows = write_reported(batch.select(*columns) if columns else batch, lambda x: x.write.parquet(f"{path}/{folder}"), {})["rows"]
    while True:
        number, state = _version(spark, path)
        if batch_id in state["batches"] or (not rows and not keep_empty and state["folders"]):
            FS.delete(spark, f"{path}/{folder}")      # nothing new, or another writer was faster with the same batch
            return None if batch_id in state["batches"] else 0
        state = {"folders": [*state["folders"], folder], "batches": [*state["batches"], batch_id]}
        if _publish(spark, path, number + 1, state):
            return rows


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the newest version."""
    path = path.rstrip("/")
    found = _version(spark, path)[1]["folders"]
    if not found:
        raise FileNotFoundError(f"no batch has been written to {path}")
    return spark.read.parquet(*[f"{path}/{f}" for f in found])


def compact(spark: SparkSession, path: str, files: int | None = None) -> int:
    """Rewrite the folders of the newest version as one, in ``files`` files (None: as Spark reads
    them); batches that arrive meanwhile are kept. Returns the number of folders replaced."""
    path = path.rstrip("/")
    old = _version(spark, path)[1]["folders"]
    if len(old) < 2:
        return 0
    rows, folder = spark.read.parquet(*[f"{path}/{f}" for f in old]), f"rows-{uuid.uuid4().hex}"
    (rows.repartition(files) if files else rows).write.parquet(f"{path}/{folder}")
    while True:
        number, state = _version(spark, path)
        if not set(old) <= set(state["folders"]):     # another compaction was faster
            FS.delete(spark, f"{path}/{folder}")
            return 0
        kept = [f for f in state["folders"] if f not in old]
        if _publish(spark, path, number + 1, {**state, "folders": [folder, *kept]}):
            return len(old)


def clean(spark: SparkSession, path: str) -> int:
    """Delete folders that the newest version does not list. Call it when no writer is at work
    and no reader holds an older version. Returns their number."""
    path = path.rstrip("/")
    listed = set(_version(spark, path)[1]["folders"])
    gone = [f for f in FS.folders(spark, path, "rows-") if f.rsplit("/", 1)[1] not in listed]
    for f in gone:
        FS.delete(spark, f)
    return len(gone)
