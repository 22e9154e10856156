"""Statistics of the event log, causal edges and critical paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.durations import days
from ..operators import causal, stats
from ..sources import events as ev
from .detectors import flagged
from .registry import query

_SENT = "sent AS (SELECT sender AS user_id, count(*) AS n FROM messages GROUP BY sender)"


def _sent(spark, sf_dir):
    return stats.activity(ev.messages(spark, sf_dir), "sender")


@query(f"{_SENT} SELECT:: n, count(*) AS users FROM sent GROUP BY n")
def activity_histogram(spark, sf_dir):
    return stats.histogram(_sent(spark, sf_dir))


@query(f"{_SENT}, ranked AS (SELECT row_number() OVER (ORDER BY n DESC) AS rank, n / sum(n) OVER () AS p FROM sent), steps AS (WITH RECURSIVE r(k) AS (SELECT CAST(1 AS BIGINT) UNION ALL SELECT k + greatest(1, k // 10) FROM r WHERE k < 1000000000) SELECT k FROM r), slope AS (SELECT regr_slope(ln(p), ln(rank)) AS s FROM ranked JOIN steps ON k = rank) SELECT:: round(-s, 6) AS zipf, round(1 + 1 / (-s), 6) AS alpha FROM slope")
def powerlaw_ols(spark, sf_dir):
    counts = _sent(spark, sf_dir)
    fit = stats.powerlaw_slope(counts, counts.count())
    return fit.select(F.round("zipf", 6).alias("zipf"), F.round("alpha", 6).alias("alpha"))


@query(f"{_SENT}, fit AS (SELECT 1 + count(*) / sum(ln(n / 5.0)) AS alpha FROM sent WHERE n >= 5) SELECT:: round(alpha, 6) AS alpha, round(1 / (alpha - 1), 6) AS zipf FROM fit")
def powerlaw_mle(spark, sf_dir):
    return stats.powerlaw_mle(_sent(spark, sf_dir)).select(F.round("alpha", 6).alias("alpha"), F.round("zipf", 6).alias("zipf"))


@query("SELECT:: count(*) AS messages, count(*) FILTER (is_friend) AS to_friends FROM flagged")
def friend_message_share(spark, sf_dir):
    return flagged(spark, sf_dir).agg(F.count(F.lit(1)).alias("messages"), F.count(F.when(F.col("is_friend"), 1)).alias("to_friends"))


@query("SELECT:: count(*) AS n FROM (SELECT sender AS u FROM messages UNION ALL SELECT recipient FROM messages UNION ALL SELECT user_a FROM friendships UNION ALL SELECT user_b FROM friendships) WHERE u <= 0")
def invalid_ids(spark, sf_dir):
    bad = lambda t, *cols: t.agg(F.sum(sum(((F.col(c) <= 0).cast("long") for c in cols), F.lit(0))).alias("n"))
    both = bad(ev.messages(spark, sf_dir), "sender", "recipient").unionByName(bad(ev.friendships(spark, sf_dir), "user_a", "user_b"))
    return both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


@query("SELECT:: count(*) AS events, (SELECT count(DISTINCT u) FROM (SELECT sender AS u FROM messages UNION ALL SELECT recipient FROM messages)) AS users, (SELECT count(*) FROM friends) AS friendships, (SELECT count(*) FROM messages) AS messages FROM raw_events")
def event_stats(spark, sf_dir):
    """Counts of events, users, friendships and messages, from three aggregations of one row each."""
    from .detectors import friends

    m = ev.messages(spark, sf_dir)
    users = m.select(F.explode(F.array("sender", "recipient")).alias("u")).agg(F.countDistinct("u").alias("users"))
    rows = ev.raw_events(spark, sf_dir).agg(F.count(F.lit(1)).alias("events"))
    pairs, sent = friends(spark, sf_dir).agg(F.count(F.lit(1)).alias("friendships")), m.agg(F.count(F.lit(1)).alias("messages"))
    parts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [rows, users, pairs, sent])
    return parts.agg(*[F.max(n).alias(n) for n in ("events", "users", "friendships", "messages")])


@query("r AS (SELECT event_id % 4 AS part, ts, row_number() OVER (PARTITION BY event_id % 4 ORDER BY ts, event_id) AS k FROM raw_events), s AS (SELECT part, min(ts) AS a, max(ts) AS b FROM r WHERE k <= 10000 GROUP BY part) SELECT:: min(a) AS start_ts, CAST(sum(b - a) // count(*) AS DOUBLE) / 10000 AS interval_ms FROM s")
def event_rate_estimate(spark, sf_dir):
    return stats.event_rate(ev.raw_events(spark, sf_dir), F.col("event_id") % 4)


_COARSE = "coarse AS (SELECT event_id, ts // 3600000 * 3600000 AS ts FROM raw_events)"


@query(f"{_COARSE}, marked AS (SELECT event_id, ts, CASE WHEN ts = lag(ts) OVER (ORDER BY ts, event_id) THEN 1 ELSE 0 END AS d FROM coarse) SELECT:: event_id, ts + CAST(sum(d) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS ts FROM marked")
def dedupe_timestamps(spark, sf_dir):
    """Times cut to hours, so that they tie, and then moved apart by a millisecond at every repeat."""
    coarse = ev.raw_events(spark, sf_dir).select("event_id", (F.floor(F.col("ts") / 3_600_000) * 3_600_000).alias("ts"))
    return stats.separate_ties(coarse).select("event_id", "ts")


@query("c AS (SELECT sender % 8 AS part, count(*) AS n FROM messages GROUP BY ALL) SELECT:: round(max(n) * count(n) / sum(n), 6) AS skew, quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.75) AS q3, round(avg(n), 6) AS mean, max(n) AS largest FROM c")
def run_skew(spark, sf_dir):
    parts = ev.messages(spark, sf_dir).groupBy((F.col("sender") % 8).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    return stats.skew(parts, "n").select(F.round("skew", 6).alias("skew"), "q1", "median", "q3", F.round("mean", 6).alias("mean"), "largest")


_ACCESS = """cells AS (SELECT sender AS cell, ts, max(w) AS w, min(w) AS least_w FROM (
    SELECT sender, ts, 1 AS w FROM messages UNION ALL SELECT recipient, ts, 0 FROM messages) GROUP BY ALL),
seen AS (SELECT ts, w, max(ts) FILTER (w = 1) OVER (PARTITION BY cell ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS src,
    max(ts) FILTER (least_w = 0) OVER (PARTITION BY cell ORDER BY ts RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS last_read FROM cells),
edges AS (SELECT DISTINCT src AS src_ts, ts AS dst_ts FROM seen WHERE src IS NOT NULL AND (w = 0 OR last_read IS NOT NULL))"""


def _edges(spark, sf_dir):
    """Each message writes its sender's cell and reads its recipient's."""
    m = ev.messages(spark, sf_dir)
    return causal.causal_edges(m.select(F.col("sender").alias("cell"), "ts"), m.select(F.col("recipient").alias("cell"), "ts"), ["cell"]).distinct()


@query(f"{_ACCESS} SELECT:: src_ts, dst_ts FROM edges")
def causal_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@query(f"{_ACCESS}, ends AS (SELECT src_ts AS v, 'source' AS role FROM edges WHERE src_ts NOT IN (SELECT dst_ts FROM edges) UNION SELECT dst_ts, 'sink' FROM edges WHERE dst_ts NOT IN (SELECT src_ts FROM edges)) SELECT:: v AS vertex, role FROM ends")
def causal_end_points(spark, sf_dir):
    return causal.end_points(_edges(spark, sf_dir))


@query(f"{_ACCESS}, paths AS (WITH RECURSIVE b AS (SELECT DISTINCT CAST(floor((dst_ts - 1704067200000) / 86400000) AS BIGINT) AS batch, src_ts, dst_ts FROM edges), p(batch, v, n) AS (SELECT DISTINCT batch, src_ts, CAST(0 AS BIGINT) FROM b UNION SELECT b.batch, b.dst_ts, p.n + 1 FROM p JOIN b ON b.batch = p.batch AND b.src_ts = p.v) SELECT * FROM p) SELECT:: batch, max(n) AS length, count(DISTINCT v) AS vertices FROM paths GROUP BY batch")
def critical_path(spark, sf_dir):
    """Longest path and vertices of each day's causal edges."""
    return causal.critical_paths(causal.batch_edges(_edges(spark, sf_dir), ev.FIRST_PROBE, days(1)))
