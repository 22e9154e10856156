"""Features from the design notes: search popularity, votes, activity and sending behaviour.

The event table has no searches and votes, so views stand for both: a view's search terms follow from its id, its
user votes on user k, and even ids are positive.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.durations import days, hours
from ..operators import state
from ..sources import events as ev
from .detectors import flagged
from .registry import query

_SEARCH = "searches AS (SELECT event_id, ts, sku, unnest(['t' || event_id % 11, 's' || event_id % 5]) AS term FROM product_views)"
_VOTES = "votes AS (SELECT ts, event_id, user_id AS voter, k AS voted, event_id % 2 = 0 AS positive FROM raw_events WHERE event_type = 'view')"


def searches(spark, sf_dir):
    terms = F.array(F.concat(F.lit("t"), (F.col("event_id") % 11).cast("string")), F.concat(F.lit("s"), (F.col("event_id") % 5).cast("string")))
    return ev.product_views(spark, sf_dir).select("event_id", "ts", "sku", F.explode(terms).alias("term"))


def votes(spark, sf_dir):
    e = ev.raw_events(spark, sf_dir).where("event_type = 'view'")
    return e.select("ts", "event_id", F.col("user_id").alias("voter"), F.col("k").alias("voted"), (F.col("event_id") % 2 == 0).alias("positive"))


def _term_popularity(spark, sf_dir):
    s = searches(spark, sf_dir)
    s = state.running(s, ["term", "sku"], {"chosen": ("count", F.lit(1))}, split_ms=days(7))
    return state.running(s, ["term"], {"searched": ("count", F.lit(1))}, split_ms=days(1), settle=True)


@query(f"{_SEARCH} SELECT:: event_id, term, count(*) OVER (PARTITION BY term, sku ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chosen, count(*) OVER (PARTITION BY term ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS searched FROM searches")
def term_popularity(spark, sf_dir):
    """At each view and search term: searches of the term so far, and those of them that chose this product."""
    return _term_popularity(spark, sf_dir).select("event_id", "term", "chosen", "searched")


@query(f"{_SEARCH}, c AS (SELECT event_id, count(*) OVER (PARTITION BY term, sku ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / count(*) OVER (PARTITION BY term ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM searches), o AS (SELECT event_id, count(*) OVER (PARTITION BY sku ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / count(*) OVER (ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM product_views), t AS (SELECT event_id, sum(ln(p)) AS s FROM c GROUP BY event_id) SELECT:: event_id, round(t.s + ln(o.p), 5) AS log_score FROM t JOIN o USING (event_id)")
def naive_bayes_search(spark, sf_dir):
    """Logarithm of the product of a view's term popularities and its product's overall popularity."""
    terms = _term_popularity(spark, sf_dir).groupBy("event_id").agg(F.sum(F.log(F.col("chosen") / F.col("searched"))).alias("s"))
    v = state.running(ev.product_views(spark, sf_dir), ["sku"], {"views": ("count", F.lit(1))}, split_ms=days(7))
    v = state.running_total(v, {"total": ("count", F.lit(1))}, days(1), settle=True)
    return v.join(terms, "event_id").select("event_id", F.round(F.col("s") + F.log(F.col("views") / F.col("total")), 5).alias("log_score"))


@query("WITH words AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM documents), tf AS (SELECT doc_id, word, count(*) AS n FROM words WHERE word IN ('the', 'and', 'que', 'der') GROUP BY ALL), df AS (SELECT word, count(*) AS d FROM tf GROUP BY word) SELECT doc_id, round(sum(sqrt(n) * power(1 + ln((SELECT count(*) FROM documents) / (1 + d)), 2)), 5) AS score FROM tf JOIN df USING (word) GROUP BY doc_id")
def tf_idf_search(spark, sf_dir):
    """Documents by sqrt(tf) times (1 + ln(N / (1 + df))) squared for four terms; a few frequencies are broadcast."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = docs.select("doc_id", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where(F.col("word").isin("the", "and", "que", "der"))
    tf = words.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    df = F.broadcast(tf.groupBy("word").agg(F.count(F.lit(1)).alias("d")))  # four rows
    total = docs.count()
    score = F.sum(F.sqrt("n") * F.pow(1 + F.log(F.lit(total) / (1 + F.col("d"))), 2))
    return tf.join(df, "word").groupBy("doc_id").agg(F.round(score, 5).alias("score"))


@query(f"{_VOTES} SELECT:: event_id, count(*) FILTER (positive) OVER w AS positive, count(*) OVER w AS votes FROM votes WINDOW w AS (PARTITION BY voter ORDER BY ts RANGE BETWEEN 604799999 PRECEDING AND CURRENT ROW)")
def recent_positive_votes(spark, sf_dir):
    w = {"good": (F.count(F.when(F.col("positive"), 1)), days(7)), "votes": (F.count(F.lit(1)), days(7))}
    return state.sliding(votes(spark, sf_dir), ["voter"], w).select("event_id", F.col("good").alias("positive"), "votes")


@query(f"{_VOTES}, last AS (SELECT event_id, ts, voter, max(ts) OVER (PARTITION BY voter ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM votes) SELECT:: l.event_id, (SELECT count(*) FROM votes r WHERE r.voted = l.voter AND r.ts <= l.ts AND (l.before IS NULL OR r.ts > l.before)) AS received FROM last l")
def votes_received_since_voted(spark, sf_dir):
    """At each vote: votes on the voter since they last voted, as a difference of two as-of counts of one stream."""
    v = votes(spark, sf_dir)
    mine = state.running(v, ["voter"], {"before": ("max", F.col("ts"))}, strict=True, split_ms=days(7)).select("event_id", F.col("voter").alias("user"), "ts", "before")
    got = v.select(F.col("voted").alias("user"), "ts", F.lit(1).alias("one"))
    now = state.asof_running(mine, got, ["user"], {"n": ("count", "one")}, split_ms=days(7), settle=True)
    then = now.select("event_id", "user", F.col("before").alias("ts"), F.col("n").alias("n_now"))
    both = state.asof_running(then, got, ["user"], {"n": ("count", "one")}, split_ms=days(7), settle=True)
    return both.select("event_id", (F.coalesce("n_now", F.lit(0)) - F.when(F.col("ts").isNull(), 0).otherwise(F.coalesce("n", F.lit(0)))).alias("received"))


@query("SELECT:: p.probe_ts, u.user_id, p.probe_ts - max(u.ts) AS idle_ms FROM probes p JOIN raw_events u ON u.ts <= p.probe_ts GROUP BY p.probe_ts, u.user_id")
def user_idle_time(spark, sf_dir):
    """At each probe: how long ago each user was last active, along the probes from each user's last time between two."""
    e = ev.raw_events(spark, sf_dir)
    found = state.running_at_probes(e, ev.probe_times(spark, sf_dir), {"last": F.col("ts")}, ("user_id",), fold="max").where("last is not null")
    return found.select("probe_ts", "user_id", (F.col("probe_ts") - F.col("last")).alias("idle_ms"))


@query("SELECT:: message_id, count(*) OVER (PARTITION BY sender_ip ORDER BY ts RANGE BETWEEN 86399999 PRECEDING AND CURRENT ROW) * 2 > count(*) OVER (PARTITION BY sender_ip ORDER BY ts RANGE BETWEEN 604799999 PRECEDING AND CURRENT ROW) AS sudden FROM messages")
def sudden_increase_by_address(spark, sf_dir):
    """Whether over half of the address' messages of seven days came in the last one."""
    one = F.lit(1)
    w = state.sliding(ev.messages(spark, sf_dir).select("ts", "message_id", "sender_ip"), ["sender_ip"], {"d1": ("count", one, days(1)), "d7": ("count", one, days(7))})
    return w.select("message_id", (F.col("d1") * 2 > F.col("d7")).alias("sudden"))


@query("SELECT:: message_id, count(*) FILTER (is_friend) OVER w AS to_friends, count(*) OVER w AS n FROM flagged WINDOW w AS (PARTITION BY sender ORDER BY ts RANGE BETWEEN 604799999 PRECEDING AND CURRENT ROW)")
def recent_messages_to_friends(spark, sf_dir):
    w = {"to_friends": (F.count(F.when(F.col("is_friend"), 1)), days(7)), "n": (F.count(F.lit(1)), days(7))}
    return state.sliding(flagged(spark, sf_dir), ["sender"], w).select("message_id", "to_friends", "n")


@query("answered AS (SELECT m.message_id, m.sender, (SELECT min(b.ts) FROM messages b WHERE b.sender = m.recipient AND b.recipient = m.sender AND b.ts > m.ts) <= m.ts + 86400000 AS ok FROM messages m) SELECT:: sender, count(*) FILTER (ok) AS answered, count(*) AS n FROM answered GROUP BY sender")
def answered_within_day(spark, sf_dir):
    """Messages that were answered within 24 hours: the next message back is the last one in reversed time."""
    m = ev.messages(spark, sf_dir).withColumn("rev", -F.col("ts"))
    asked = m.select("message_id", "sender", F.col("recipient").alias("a"), F.col("sender").alias("b"), "rev")
    back = m.select(F.col("sender").alias("a"), F.col("recipient").alias("b"), "rev", F.lit(1).alias("one"))
    found = state.asof(asked, back, ["a", "b"], ["one"], ts="rev", strict=True, within_ms=hours(24) + 1, split_ms=days(7))
    return found.groupBy("sender").agg(F.count("one").alias("answered"), F.count(F.lit(1)).alias("n"))
