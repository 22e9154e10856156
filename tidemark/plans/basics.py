"""Scans, counts, set operations and file layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import contains_email, has_email, partition_of
from ..operators import state
from ..sources import events as ev
from ..sources.files import first_events
from .registry import query


@query("SELECT:: ts, message_id, sender, recipient, sender_ip, content FROM messages")
def scan_messages(spark, sf_dir):
    return ev.messages(spark, sf_dir)


@query("SELECT:: ts, user_a, user_b FROM friendships")
def scan_friendships(spark, sf_dir):
    return ev.friendships(spark, sf_dir)


@query("SELECT:: ts, message_id, sender FROM messages ORDER BY ts, message_id LIMIT 100")
def scan_limit(spark, sf_dir):
    return first_events(ev.messages(spark, sf_dir).select("ts", "message_id", "sender"), 100, tiebreak="message_id")


@query("SELECT event_type, count(*) AS cnt FROM events GROUP BY event_type")
def event_counts_by_type(spark, sf_dir):
    return ev.raw_events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("cnt"))


@query("SELECT count(*) AS n FROM events")
def count_all(spark, sf_dir):
    return ev.raw_events(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT:: count(*) AS n, count(DISTINCT sender) AS senders, 0 AS split_senders FROM messages")
def repartition_roundtrip(spark, sf_dir):
    """Dealing by key hash keeps every row, and no key falls into two parts."""
    m = ev.messages(spark, sf_dir).select("sender", partition_of(F.col("sender"), 8).alias("part"))
    per_key = m.groupBy("sender").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("a"), F.max("part").alias("b"))
    return per_key.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("senders"), F.sum((F.col("a") != F.col("b")).cast("int")).cast("int").alias("split_senders"))


@query("SELECT:: 'message' AS kind, ts, sender AS user_id FROM messages UNION ALL SELECT 'friendship', ts, user_a FROM friendships")
def union_streams(spark, sf_dir):
    m = ev.messages(spark, sf_dir).select(F.lit("message").alias("kind"), "ts", F.col("sender").alias("user_id"))
    return m.unionByName(ev.friendships(spark, sf_dir).select(F.lit("friendship").alias("kind"), "ts", F.col("user_a").alias("user_id")))


@query("SELECT:: DISTINCT sender AS user_id FROM messages")
def distinct_users(spark, sf_dir):
    return ev.messages(spark, sf_dir).select(F.col("sender").alias("user_id")).distinct()


@query("SELECT:: sender AS user_id FROM messages EXCEPT SELECT recipient FROM messages")
def vertex_difference(spark, sf_dir):
    """Users who send and never receive."""
    m = ev.messages(spark, sf_dir)
    return m.select(F.col("sender").alias("user_id")).distinct().join(m.select(F.col("recipient").alias("user_id")).distinct(), "user_id", "left_anti")


@query("SELECT doc_id, regexp_matches(text, '[\\w-_\\.+]*[\\w-_\\.]\\@([\\w]+\\.)+[\\w]+[\\w]') AS has_email, regexp_matches(text, '\\b[A-z0-9._%+-]+@[A-z0-9.-]+\\.[A-z]{2,}\\b') AS contains_email FROM documents")
def email_flags(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", has_email(F.col("text")).alias("has_email"), contains_email(F.col("text")).alias("contains_email"))


@query("SELECT:: sender, min(ts) AS ts FROM messages GROUP BY sender")
def first_seen_min(spark, sf_dir):
    return ev.messages(spark, sf_dir).groupBy("sender").agg(F.min("ts").alias("ts"))


@query("SELECT:: message_id, sender, max(ts) OVER (PARTITION BY sender ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ts FROM messages")
def last_seen_max(spark, sf_dir):
    """When the sender last wrote before: a strict running maximum."""
    return state.running(ev.messages(spark, sf_dir), ["sender"], {"last": ("max", F.col("ts"))}, strict=True).select("message_id", "sender", F.col("last").alias("ts"))


@query("SELECT:: message_id, sender, max(CASE WHEN content LIKE '%@%' THEN 1 ELSE 0 END) OVER (PARTITION BY sender ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 AS ever FROM messages")
def ever_flag(spark, sf_dir):
    mail = F.when(has_email(F.col("content")), F.col("ts"))
    out = state.running(ev.messages(spark, sf_dir), ["sender"], {"since": ("min", mail)}, split_ms=7 * 86_400_000)
    return out.select("message_id", "sender", F.col("since").isNotNull().alias("ever"))


@query("SELECT:: sender, CAST(list_reduce(list_prepend(CAST(5 AS BIGINT), list(CASE WHEN message_id % 3 = 0 THEN -1 ELSE message_id % 7 END ORDER BY ts, message_id)), lambda a, b: CASE WHEN b < 0 THEN a * 3 % 1000003 ELSE a + b END) AS BIGINT) AS value FROM messages GROUP BY sender")
def ordered_fold(spark, sf_dir):
    """A fold that does not commute: every third message multiplies, the others add."""
    triple = F.col("message_id") % 3 == 0
    ledger = ev.messages(spark, sf_dir).select("sender", "ts", F.col("message_id").alias("seq"), F.when(triple, "triple").otherwise("add").alias("op"), (F.col("message_id") % 7).alias("arg"))
    return state.ordered_fold(ledger, ["sender"], {"triple": lambda z, a: z * 3 % 1000003, "add": lambda z, a: z + a}, 5, "bigint")


@query("SELECT user_id, count(*) AS cnt FROM events GROUP BY user_id ORDER BY md5(user_id || ':1'), user_id LIMIT 1")
def random_entry(spark, sf_dir):
    """A seeded random entry of the state of events by user."""
    counts = ev.raw_events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("cnt"))
    return state.random_entry(counts, "user_id")


@query("SELECT:: message_id FROM messages WHERE false")
def do_nothing(spark, sf_dir):
    """Reads every message and returns none: the floor of a replay."""
    return ev.messages(spark, sf_dir).where(F.col("ts") < 0).select("message_id")
