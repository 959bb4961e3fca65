"""Cutting lineage without trusting any single executor's disk."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_owned: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The folder all nodes share: spark.checkpoint.dir, else the context's own, else (local masters only) a temporary one."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share; a temporary one lies on one machine")
        root = "file://" + tempfile.mkdtemp(prefix="storyline-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def durable(df: DataFrame, row_group_bytes: int | None = None, compression: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and return it read back.

    Later stages restart from those files when an executor is lost. The files go
    with ``release`` or when the application's JVM ends, stopped session or not.
    """
    spark = df.sparkSession
    folder = f"{shared_root(spark)}/storyline-{spark.sparkContext.applicationId}"
    if folder not in _owned:
        _owned.add(folder)
        path, files = _hadoop(spark, folder)
        files.mkdirs(path)
        files.deleteOnExit(path)
    path = f"{folder}/{uuid.uuid4().hex}"
    writer = df.write.option("parquet.block.size", row_group_bytes) if row_group_bytes else df.write
    writer.parquet(path, compression=compression)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._durable_path = path
    return kept


def release(df: DataFrame) -> None:
    """Delete a durable table that nothing will read again; other frames are left alone."""
    if path := df.__dict__.pop("_durable_path", None):
        path, files = _hadoop(df.sparkSession, path)
        files.delete(path, True)


def _hadoop(spark: SparkSession, path: str):
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(sc._jsc.hadoopConfiguration())
