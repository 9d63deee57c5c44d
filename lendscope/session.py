"""Session construction and shared-folder helpers.

On a cluster the operator reads ``spark.checkpoint.dir`` (a shared folder
that survives executor loss). Only when it is unset -- local runs and tests --
do we pick a folder of our own.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}
# Only for one-process runs; a cluster sizes its reducers and driver itself.
_LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.driver.memory": "16g",
}


def is_local(master: str) -> bool:
    """True for a one-process master (``local``, ``local[n]``)."""
    return master == "local" or master.startswith("local[")


def get_spark(master: str | None = None, app: str = "lendscope", **conf: str) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    local = is_local(master or os.environ.get("MASTER", "local"))
    for k, v in {**_DEFAULTS, **(_LOCAL_DEFAULTS if local else {}), **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only if unset."""
    sc = spark.sparkContext
    path = sc.getCheckpointDir()
    if path:
        return path
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not path:
        if not is_local(sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # One process (local runs, tests): its own folder is shared by definition.
        path = tempfile.mkdtemp(prefix="lendscope-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for written tables."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "lendscope", f"{name}-{uuid.uuid4().hex[:12]}")


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder as parquet and read it back: the
    lineage ends there, later passes read only the columns they need, and the
    files outlive any executor. Use as ``df.transform(stage)``."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
