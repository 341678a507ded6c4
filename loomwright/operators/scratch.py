"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir, else (in one process, as in tests) a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="loomwright-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it again, so later steps depend on no executor's memory or disk."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/loomwright-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(discard_path, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard_path(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate table; quiet when the session has already gone."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the gateway is closed at exit
        pass


def discard(*frames: DataFrame) -> None:
    for df in frames:
        if path := getattr(df, "_scratch_path", None):
            discard_path(df.sparkSession, path)
