"""Streaming forms of counting, limiting and de-duplicating events."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestar.storage import shared_path

#: Days a topic count is kept. Fixed value.
WINDOW_DAYS = 30
#: Requests a client may make in so many seconds. Fixed values.
LIMIT, LIMIT_SECONDS = 120, 60


def event_stream(spark: SparkSession, folder: str, schema: T.StructType, per_trigger: int = 1) -> DataFrame:
    """A stream over the Parquet files of a folder, event time as a timestamp."""
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return files.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_topics(events: DataFrame, retention_days: int = WINDOW_DAYS) -> DataFrame:
    """(event_type, day, n): counts per topic and day; events older than the retention are dropped."""
    late = events.withWatermark("ts", f"{retention_days} days")
    return late.groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("event_type", F.to_date("w.start").alias("day"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, started, ended, n): visits separated by a gap."""
    late = events.withWatermark("ts", "1 day")
    return late.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def first_sightings(events: DataFrame, key: str, within: str = "1 day") -> DataFrame:
    """Events without repeats of a key inside the watermark."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark([key])


LIMITED = "client long, ts timestamp, event_id long, granted boolean"


def rate_limited(events: DataFrame, limit: int = LIMIT, seconds: int = LIMIT_SECONDS) -> DataFrame:
    """Sliding-log limiter: at most ``limit`` granted requests in any ``seconds``; rejected ones are not counted.

    The state of a client is the list of its granted times inside the window, so at most
    ``limit`` numbers. A hit exactly at the edge of the window still counts.
    """

    def decide(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        granted = []
        for t in rows["ts"].astype("datetime64[us]").astype("int64"):
            held = [h for h in held if h >= t - seconds * 1_000_000]
            ok = len(held) < limit
            if ok:
                held.append(int(t))
            granted.append(ok)
        state.update((held,))
        yield pd.DataFrame({"client": key[0], "ts": rows["ts"], "event_id": rows["event_id"], "granted": granted})

    rows = events.select(F.col("user_id").alias("client"), "ts", "event_id")
    return rows.groupBy("client").applyInPandasWithState(decide, LIMITED, "held array<long>", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now and give its result as a table in the shared folder.

    ``append`` goes to a file sink; ``complete`` and ``update`` results are written per
    batch with ``foreachBatch``, the last complete one counts.
    """
    spark = stream.sparkSession
    target, checkpoint = shared_path(spark, label), shared_path(spark, f"{label}-checkpoint")
    if mode == "append":
        query = stream.writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    else:
        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(target)

        query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)
