"""Incremental maintenance of an index from a stream of records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.maintenance import pending
from lodestar.operators.records import latest_per_key
from lodestar.storage import shared_path


def maintained_index(stream: DataFrame, key: str, version: str, digest: str, build: Callable[[DataFrame], DataFrame], label: str = "index") -> DataFrame:
    """Keep an index of the latest version of every record, building only what is new or changed.

    Each micro-batch is reduced to the latest row a key, compared with the index by
    content hash, and only pending rows go through ``build``, which keeps ``key``,
    ``version`` and ``digest`` and adds what it likes. A generation of the index is
    written whole to the shared folder and swapped in, so a repeated batch after a failure
    changes nothing.
    """
    spark = stream.sparkSession
    held: dict[str, str] = {}

    def batch(rows: DataFrame, number: int) -> None:
        fresh = latest_per_key(rows, [key], [version], rows.columns)
        if "path" in held:
            old = spark.read.parquet(held["path"])
            todo = pending(fresh, old, key, digest)
            merged = old.unionByName(build(todo))
            merged = latest_per_key(merged, [key], [version], merged.columns)
        else:
            merged = build(fresh)
        path = shared_path(spark, f"{label}-{number}")
        merged.write.parquet(path)
        held["path"] = path

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", shared_path(spark, f"{label}-checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    if "path" not in held:
        return build(spark.createDataFrame([], stream.schema))
    return spark.read.parquet(held["path"])


def content_versions(stream: DataFrame, key: str, version: str, *content: str) -> DataFrame:
    """(key, version, digest, content) with a hash over the content, nulls as ''."""
    joined = F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in content])
    return stream.select(key, version, F.sha2(joined, 256).alias("digest"), *content)
