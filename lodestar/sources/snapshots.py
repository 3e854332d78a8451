"""Snapshot files: scans with a fixed schema, fallbacks, and guarded publication."""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.schemas import SNAPSHOT

log = logging.getLogger(__name__)
#: Parts of file names that are no published snapshot. Fixed values.
UNPUBLISHED = ("staging", "checkpoint", "tmp", "fallback")


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _filesystem(spark, path)
    found = fs.globStatus(p)
    return found is not None and len(found) > 0


def read_snapshot(spark: SparkSession, path: str, schema: str = SNAPSHOT) -> DataFrame:
    """Records of JSON arrays (a byte order mark is tolerated); missing fields are null, a missing file gives no rows."""
    if not path_exists(spark, path):
        log.warning("no snapshot at %s", path)
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_published(spark: SparkSession, glob: str, schema: str = SNAPSHOT) -> DataFrame:
    """All published snapshots that a pattern names, with the file each record came from."""
    if not path_exists(spark, glob):
        return spark.createDataFrame([], f"{schema}, file_name string")
    rows = spark.read.schema(schema).option("multiLine", True).json(glob).withColumn("file_name", F.col("_metadata.file_name"))
    return rows.where(~F.lower("file_name").rlike("|".join(UNPUBLISHED)))


def read_with_fallback(spark: SparkSession, primary: str, *fallbacks: str, schema: str = SNAPSHOT) -> DataFrame:
    """The first of several snapshots that is there and has rows."""
    for path in (primary, *fallbacks):
        rows = read_snapshot(spark, path, schema)
        if not rows.isEmpty():
            return rows
    return spark.createDataFrame([], schema)


def publish(df: DataFrame, target: str, errors: list[str], production: str | None = None, allow_production: bool = False) -> None:
    """Write to a staging folder and rename it into place, so readers see the old or the new whole.

    Refused while there are validation errors, and for the production path without the flag.
    """
    if errors:
        raise ValueError("not published: " + "; ".join(errors))
    if production and target.rstrip("/") == production.rstrip("/") and not allow_production:
        raise PermissionError("the production path needs allow_production")
    spark = df.sparkSession
    staging, old = f"{target.rstrip('/')}.staging-{uuid.uuid4().hex[:8]}", f"{target.rstrip('/')}.old-{uuid.uuid4().hex[:8]}"
    df.write.parquet(staging)
    fs, final = _filesystem(spark, target)
    _, staged = _filesystem(spark, staging)
    _, parked = _filesystem(spark, old)
    if fs.exists(final) and not fs.rename(final, parked):
        raise OSError(f"cannot move {target} aside")
    if not fs.rename(staged, final):
        fs.rename(parked, final)
        raise OSError(f"cannot move {staging} into place")
    if fs.exists(parked):
        fs.delete(parked, True)
