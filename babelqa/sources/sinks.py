"""Writers: submission CSV, training tables, incremental results.

Every writer produces a directory of part files through Spark's output committer, so
an executor lost mid-write leaves no partial result: the job retries the task and only
committed files become visible.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .qa import CSV_OPTIONS
from .results import write_batch


def write_csv(df: DataFrame, path: str, single_file: bool = False, mode: str = "overwrite") -> str:
    """Submission CSV with a header and no index column. ``single_file`` coalesces to
    one part only when asked (it funnels all rows through one task)."""
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).options(**CSV_OPTIONS).csv(path)
    return path


def write_training_set(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Hand an SFT / preference table to a trainer as Parquet (nested types kept)."""
    df.write.mode(mode).parquet(path)
    return path


def write_incremental(batch: DataFrame, path: str, batch_id: str, columns=None) -> int | None:
    """Make one batch of results durable under its identity (the toolkit rewrote the whole file
    after every batch); a batch that comes again is not taken twice. ``columns`` projects
    first, as the test mode does. Read the table with ``results.read_results``."""
    return write_batch(batch, path, batch_id, columns)
