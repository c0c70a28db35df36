"""Tables written to the folder that the driver and all executors see: they cut a plan that has grown, and outlive a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names. Only a session of one process may leave it unset and gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-work-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write a table and read it back. Whoever owns the folder empties it."""
    path = f"{shared_root(df.sparkSession)}/tables/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
