"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) -> (node, comp): the smallest node reachable from each node.

    Every step takes the smallest label among a node's neighbours, then follows that label
    once (which doubles the distance labels travel). A hub's edges meet in a partial
    minimum, so no task gathers a hot node's neighbours. Labels are written to the shared
    folder each step: a lost executor re-reads them. No edge: an empty table."""
    both = edges.select("a", "b").where("a <> b")
    both = written(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp"))
                     .withColumn("moved", F.lit(True)), "labels")
    while not labels.where("moved").isEmpty():
        near = (both.join(labels.select(F.col("node").alias("b"), "comp"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near")))
        step = labels.select("node", "comp").join(near, "node").select(
            "node", F.col("comp").alias("was"), F.least("comp", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("comp").alias("far"))
        step = step.join(jump, "mid", "left").select(
            "node", F.least("mid", "far").alias("comp"), (F.least("mid", "far") < F.col("was")).alias("moved"))
        labels = written(step, "labels")
    return labels.select("node", "comp")
