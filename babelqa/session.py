"""Session construction and the shared scratch location.

On a cluster the session is built by the platform; ``get_session`` only fills in
settings that are unset. Scratch data (stream checkpoints, materialised tables) always
goes under ``spark.checkpoint.dir``, the folder the cluster shares between executors.
"""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings the library is tuned for. AQE re-plans at runtime: it coalesces small
# shuffle partitions, splits skewed join partitions and turns a join into a broadcast
# join only after measuring the real size of a side.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "babelqa", shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder. A local master without one gets a local folder;
    on any other master a missing folder is an error, since executors would not share it."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        path = tempfile.mkdtemp(prefix="babelqa-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused folder below the shared checkpoint folder, its scheme kept."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/babelqa-{name}-{uuid.uuid4().hex}"


def measured(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under the shared folder and read it back. Lineage is cut, and the
    planner knows the table's real size: it broadcasts a side of a join only if its bytes are
    within ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it otherwise."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers (once per application), so that functions
    which run in tasks can be imported wherever the driver was started. The archive lies in
    the shared folder, from where Spark fetches it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root, data = os.path.dirname(os.path.abspath(__file__)), io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_path(spark, 'package')}/babelqa.zip")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(data.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(path.toString())
    _shipped.add(app)
