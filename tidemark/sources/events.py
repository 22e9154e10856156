"""Event tables, one per kind, from the ``events`` table; ts is always epoch milliseconds.

Every kind is a filter and a projection of one scan, so the filter on event_type and the columns reach Parquet.
``SQL`` holds the same tables as common table expressions for oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

MESSAGE_TYPES = ("click", "error", "purchase")
DAY = 86_400_000
FIRST_PROBE = 1704067200000  # 2024-01-01 00:00 UTC, where batches are counted from


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape(spark.read.parquet(f"{sf_dir}/events.parquet"))


def shape(events: DataFrame) -> DataFrame:
    """The event table or stream as ts, event_id, user_id, event_type, value, k."""
    zone = events.sparkSession.conf.get("spark.sql.session.timeZone")
    if isinstance(events.schema["ts"].dataType, TimestampType) or zone in ("UTC", "Etc/UTC", "Z", "+00:00"):
        ts = F.unix_millis(F.col("ts").cast("timestamp"))
    else:  # a time without a zone counts as UTC, whatever the session's zone is
        ts = F.expr("cast(floor(cast(cast(ts - timestamp_ntz'1970-01-01 00:00:00' as interval second) as decimal(20, 6)) * 1000) as bigint)")
    return events.select(ts.alias("ts"), "event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


def content() -> Column:
    """A message's text, from the event's user and id."""
    user, event = F.col("user_id"), F.col("event_id")
    mail = ((user % 5 == 0) & (event % 2 == 0)) | (event % 10 == 0)
    return F.when(mail, F.concat(F.lit("hi w"), user.cast("string"), F.lit("@email.com "))).otherwise("hello there")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts, message_id, sender, recipient, sender_ip, content."""
    user, event = F.col("user_id"), F.col("event_id")
    return raw_events(spark, sf_dir).where(F.col("event_type").isin(*MESSAGE_TYPES)).select("ts", event.alias("message_id"), user.alias("sender"), F.col("k").alias("recipient"), (user % 15).cast("int").alias("sender_ip"), content().alias("content"))


def friendships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts, user_a, user_b as they come; pairs may repeat and are unordered."""
    return raw_events(spark, sf_dir).where(F.col("event_type") == "signup").select("ts", F.col("user_id").alias("user_a"), F.col("k").alias("user_b"))


def product_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_events(spark, sf_dir).where(F.col("event_type") == "view").select("ts", F.col("k").alias("sku"), "event_id")


def product_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_events(spark, sf_dir).where(F.col("event_type") == "purchase").select("ts", F.col("k").alias("sku"), "event_id")


def probe_times(spark: SparkSession, sf_dir: str) -> list[int]:
    """The start of each day from the first event's, and the last event's time: one number a day, so all events are seen."""
    ends = raw_events(spark, sf_dir).agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    if ends.a is None:
        return []
    return sorted({*range(ends.a // DAY * DAY, ends.b + 1, DAY), ends.b})


def probes(spark: SparkSession, times: list[int]) -> DataFrame:
    """Probe times as a table."""
    return spark.createDataFrame([(t,) for t in times], "probe_ts long")


SQL = f"""raw_events AS (
  SELECT epoch_us(ts) // 1000 AS ts, event_id, user_id, event_type, value, CAST(props->>'k' AS BIGINT) AS k FROM events),
messages AS (
  SELECT ts, event_id AS message_id, user_id AS sender, k AS recipient, CAST(user_id % 15 AS INTEGER) AS sender_ip,
    CASE WHEN (user_id % 5 = 0 AND event_id % 2 = 0) OR event_id % 10 = 0 THEN 'hi w' || user_id || '@email.com ' ELSE 'hello there' END AS content
  FROM raw_events WHERE event_type IN ('click', 'error', 'purchase')),
friendships AS (SELECT ts, user_id AS user_a, k AS user_b FROM raw_events WHERE event_type = 'signup'),
product_views AS (SELECT ts, k AS sku, event_id FROM raw_events WHERE event_type = 'view'),
product_updates AS (SELECT ts, k AS sku, event_id FROM raw_events WHERE event_type = 'purchase'),
probes AS (SELECT unnest(range(min(ts) // {DAY} * {DAY}, max(ts) + 1, {DAY})) AS probe_ts FROM raw_events UNION SELECT max(ts) FROM raw_events HAVING count(*) > 0),
friends AS (
  SELECT least(user_a, user_b) AS lo, greatest(user_a, user_b) AS hi, min(ts) AS since FROM friendships GROUP BY ALL),
flagged AS (
  SELECT m.*, f.since IS NOT NULL AND f.since <= m.ts AS is_friend
  FROM messages m LEFT JOIN friends f ON f.lo = least(m.sender, m.recipient) AND f.hi = greatest(m.sender, m.recipient))"""
