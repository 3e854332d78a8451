"""Reading tables and cutting lineage, the same way locally and on a cluster."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory; Catalyst prunes columns and pushes filters."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the session names none (tests on one machine) a temporary folder is made
    and set, so a cluster never falls back to a machine-local path silently.
    """
    conf = spark.sparkContext.getConf()
    path = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if path:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(path)
        return path
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not found.isEmpty():
        return found.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = os.path.join(tempfile.gettempdir(), f"lodestar-{uuid.uuid4().hex[:12]}")
    spark.sparkContext.setCheckpointDir(path)
    return path


_MADE: list[str] = []


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, remembered for ``discard_written``."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def discard_written(spark: SparkSession) -> int:
    """Delete what this process wrote to the shared folder; call it once the results that read from there are stored."""
    conf, n = spark.sparkContext._jsc.hadoopConfiguration(), 0
    while _MADE:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read back (survives lost executors)."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
