"""Analytics over events, in batch and streaming form."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.operators import timelines
from lodestar.streaming import topics
from lodestar.storage import table

TODAY = "2024-01-30"
QUOTA, PROVIDER_ZONE = 5, "America/Los_Angeles"
# The topics shown to visitors, in editorial order, with what visitors type for them. Fixed values of the fixtures.
TOPICS = [("view", ["view", "pageview"]), ("click", ["click"]), ("search", ["search", "query"]), ("purchase", ["purchase", "buy"]), ("signup", ["signup", "register"]), ("export", ["export"])]


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def _topics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, i, a) for i, (t, aliases) in enumerate(TOPICS) for a in aliases], "topic string, ord int, alias string")


def topic_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    alias = F.broadcast(_topics(spark))
    return _events(spark, d).join(alias, text.normalised(F.col("event_type")) == F.col("alias")).groupBy("topic", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def topic_rank(spark: SparkSession, d: str) -> DataFrame:
    """All topics with their counts of the last 30 days, most searched first, editorial order on ties."""
    end = F.to_date(F.lit(TODAY))
    recent = topic_daily_counts(spark, d).where(F.col("day").between(F.date_sub(end, topics.WINDOW_DAYS - 1), end)).groupBy("topic").agg(F.sum("n").alias("n"))
    every = _topics(spark).select("topic", "ord").distinct().join(recent, "topic", "left").select("topic", "ord", F.coalesce("n", F.lit(0)).alias("n"))
    return every.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), "ord"))).select("topic", "n", "rank")


def topic_rolling(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("topic").orderBy(F.unix_date("day")).rangeBetween(-6, 0)
    return topic_daily_counts(spark, d).select("topic", "day", F.sum("n").over(w).alias("n_7_days"))


def tumbling_hourly(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def rate_window_count(spark: SparkSession, d: str) -> DataFrame:
    """Requests of each client in the hour up to each of them (rejected ones included)."""
    return timelines.trailing_count(_events(spark, d).select("event_id", "user_id", "ts"), "user_id", "ts", 3600, "n_in_hour").select("event_id", "n_in_hour")


def quota_grants(spark: SparkSession, d: str) -> DataFrame:
    """The first calls of a provider on each of its local days are granted."""
    day = F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), PROVIDER_ZONE))
    w = Window.partitionBy("event_type", "day").orderBy("ts", "event_id")
    return _events(spark, d).select("event_id", "event_type", "ts", day.alias("day")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= QUOTA).select("event_id", "event_type", "rank")


def ttl_active(spark: SparkSession, d: str) -> DataFrame:
    """Entries not yet expired at a fixed time, each living for a day."""
    now = F.to_timestamp_ntz(F.lit(f"{TODAY} 00:00:00"))
    return _events(spark, d).where((F.col("ts") <= now) & (F.col("ts") + F.expr("INTERVAL 1 DAY") > now)).select("event_id", "user_id")


def evict_oldest(spark: SparkSession, d: str) -> DataFrame:
    """What a cache bounded to all but 100 entries gives up: the entries that expire first."""
    return _events(spark, d).orderBy("ts", "event_id").limit(100).select("event_id")


def event_properties(spark: SparkSession, d: str) -> DataFrame:
    """A value out of semi-structured properties, bad ones as null."""
    return _events(spark, d).select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"))


def locf_category(spark: SparkSession, d: str) -> DataFrame:
    """The last heading seen before each row of a user, carried forward."""
    head = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return timelines.carried_forward(_events(spark, d).select("event_id", "user_id", "ts", "event_type"), "user_id", "ts", "event_id", head, "last_heading").select("event_id", "last_heading")


def consented_usage(spark: SparkSession, d: str) -> DataFrame:
    """Usage rows as they may be sent: no text, a length bucket only, consenting users only."""
    return _events(spark, d).where(F.col("user_id") % 3 != 0).groupBy("event_type", text.length_bucket(F.length("props")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream: a folder of its own that links to the one file."""
    schema = _events(spark, d).schema
    return topics.event_stream(spark, f"{d}/event[s].parquet" if os.path.isfile(f"{d}/events.parquet") else f"{d}/events.parquet", schema)


def streaming_topics(spark: SparkSession, d: str) -> DataFrame:
    return topics.drained(topics.daily_topics(_stream(spark, d)), "topics", "complete")


def streaming_sessions(spark: SparkSession, d: str) -> DataFrame:
    return topics.drained(topics.sessions(_stream(spark, d)), "sessions", "complete")


def streaming_first_sightings(spark: SparkSession, d: str) -> DataFrame:
    return topics.drained(topics.first_sightings(_stream(spark, d), "event_id").select("event_id", "user_id", "event_type"), "sightings")


def rate_limiter_exact(spark: SparkSession, d: str) -> DataFrame:
    return topics.drained(topics.rate_limited(_stream(spark, d), limit=3, seconds=3600), "limited")


_TOPIC_SQL = "(VALUES " + ", ".join(f"('{t}', {i}, '{a}')" for i, (t, aliases) in enumerate(TOPICS) for a in aliases) + ") AS v(topic, ord, alias)"
_DAILY = f"daily AS (SELECT topic, CAST(ts AS DATE) AS day, count(*) AS n FROM events JOIN {_TOPIC_SQL} ON lower(trim(event_type)) = alias GROUP BY 1, 2)"
SQL = {
    "topic_daily_counts": f"WITH {_DAILY} SELECT * FROM daily",
    "topic_rank": f"WITH {_DAILY}, r AS (SELECT topic, CAST(sum(n) AS BIGINT) AS n FROM daily WHERE day BETWEEN DATE '2024-01-01' AND DATE '2024-01-30' GROUP BY 1), t AS (SELECT DISTINCT topic, ord FROM {_TOPIC_SQL}) SELECT t.topic, coalesce(n, 0) AS n, CAST(row_number() OVER (ORDER BY coalesce(n, 0) DESC, ord) AS INT) AS rank FROM t LEFT JOIN r ON r.topic = t.topic",
    "topic_rolling": f"WITH {_DAILY} SELECT topic, day, CAST(sum(n) OVER (PARTITION BY topic ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS BIGINT) AS n_7_days FROM daily",
    "tumbling_hourly": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "rate_window_count": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n_in_hour FROM events",
    "quota_grants": "WITH e AS (SELECT event_id, event_type, ts, CAST(timezone('America/Los_Angeles', timezone('UTC', ts)) AS DATE) AS day FROM events) SELECT event_id, event_type, CAST(row_number() OVER (PARTITION BY event_type, day ORDER BY ts, event_id) AS INT) AS rank FROM e QUALIFY row_number() OVER (PARTITION BY event_type, day ORDER BY ts, event_id) <= 5",
    "ttl_active": "SELECT event_id, user_id FROM events WHERE ts <= TIMESTAMP '2024-01-30' AND ts + INTERVAL 1 DAY > TIMESTAMP '2024-01-30'",
    "evict_oldest": "SELECT event_id FROM events ORDER BY ts, event_id LIMIT 100",
    "event_properties": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "locf_category": "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_heading FROM events",
    "consented_usage": "SELECT event_type, CASE WHEN length(props) = 0 THEN '0' WHEN length(props) <= 20 THEN '1-20' WHEN length(props) <= 50 THEN '21-50' ELSE '51-100' END AS bucket, count(*) AS n FROM events WHERE user_id % 3 <> 0 AND user_id IS NOT NULL GROUP BY 1, 2",
    "streaming_topics": "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2",
    "streaming_first_sightings": "SELECT DISTINCT event_id, user_id, event_type FROM events",
    "streaming_sessions": "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM e) SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS n FROM s GROUP BY user_id, no",
}
QUERIES = {name: globals()[name] for name in [*SQL, "rate_limiter_exact"]}
