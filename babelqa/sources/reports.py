"""Row counts that come out of the job that writes the rows, not out of a second scan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def write_reported(df: DataFrame, write: Callable[[DataFrame], object], counts: dict[str, Column]) -> dict[str, int]:
    """Run ``write`` on ``df`` and return ``rows`` and, for each name in ``counts``, the rows for
    which its condition held. Spark gathers the counts of the tasks whose output was committed."""
    seen = Observation()
    metrics = [F.count(F.lit(1)).alias("rows"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in counts.items()]]
    write(df.observe(seen, *metrics))
    return dict(seen.get)


def write_shards(df: DataFrame, n: int, write: Callable[[DataFrame], object], shard_col: str = "shard") -> dict[str, int]:
    """``write_reported`` with the rows of each of the ``n`` shards, as ``shard_0`` and so on."""
    return write_reported(df, write, {f"shard_{i}": F.col(shard_col) == i for i in range(n)})


def write_merged(merged: DataFrame, parts: list[str], write: Callable[[DataFrame], object]) -> dict[str, int]:
    """``write_reported`` for the rows of ``merge_parts``, with the rows of each part path, as
    ``part_0`` and so on in the order of ``parts``."""
    inside = lambda path: F.contains(F.col("part_file"), F.lit(path.rstrip("/").split(":", 1)[-1].lstrip("/") + "/"))
    return write_reported(merged, write, {f"part_{k}": inside(p) for k, p in enumerate(parts)})
