"""Declarative programs as queries, upkeep of state, file layouts, run logs and generated events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.durations import days
from ..operators import causal, state, stats
from ..sources import events as ev
from ..sources import files, generators
from . import programs
from .detectors import _COUNTED, _IP, TOP, simple_spam
from .features import _BACK
from .registry import query
from .statistics import _ACCESS, _edges


def _tables(spark, sf_dir):
    return {"messages": ev.messages(spark, sf_dir), "friendships": ev.friendships(spark, sf_dir)}


@query(f"{_COUNTED} SELECT:: message_id, CAST(f AS BIGINT) AS f, CAST(nf AS BIGINT) AS nf, nf > 2 * f AND f + nf > 5 AS is_spam FROM counted")
def program_simple_spam(spark, sf_dir):
    """The simple detector as a declarative program."""
    return programs.simple_spam().run(_tables(spark, sf_dir)).rows["spam"].select("message_id", "f", "nf", "is_spam")


@query(f"{_COUNTED}, {_IP} SELECT:: s.message_id FROM simple s JOIN by_ip i USING (message_id) WHERE i.email / (i.email + i.noemail) > 0.2")
def program_address_spam(spark, sf_dir):
    return programs.address_spam().run(_tables(spark, sf_dir)).rows["address_spam"].where("is_address_spam").select("message_id")


@query("v AS (SELECT event_id, count(*) OVER (PARTITION BY sku ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS views, count(*) OVER (ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM product_views) SELECT:: event_id, views, total, round(views / total, 6) AS popularity FROM v")
def program_popularity(spark, sf_dir):
    rows = programs.popularity().run({"views": ev.product_views(spark, sf_dir)}).rows["view"]
    return rows.select("event_id", "views", "total", F.round("popularity", 6).alias("popularity"))


@query(f"{_BACK} SELECT:: sender AS user, round(avg(ts - last_back), 3) AS mean_wait FROM answered WHERE last_back IS NOT NULL GROUP BY sender")
def program_response_times(spark, sf_dir):
    """Each user's mean wait at the end of the log, from the program's state."""
    run = programs.response_times().run({"messages": ev.messages(spark, sf_dir).drop("content")})
    return run.at("mean_wait").select("user", F.round("value", 3).alias("mean_wait"))


@query("b AS (SELECT ts, event_id % 7 AS batch FROM raw_events), top AS (SELECT batch, max(ts) AS t FROM b GROUP BY batch), read AS (SELECT batch, max(t) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM top) SELECT:: batch, count(*) AS late FROM b JOIN read USING (batch) WHERE ts <= seen GROUP BY batch")
def late_writes(spark, sf_dir):
    """Events that are not later than all of the batches before theirs, by batch: what a strict state refuses."""
    b = ev.raw_events(spark, sf_dir).select("ts", (F.col("event_id") % 7).alias("batch"))
    return state.late_writes(b, "batch").groupBy("batch").agg(F.count(F.lit(1)).alias("late"))


@query(f"{_COUNTED} SELECT:: sender, count(*) AS cnt FROM simple GROUP BY sender ORDER BY cnt DESC, sender LIMIT 5")
def top_spammers_maintained(spark, sf_dir):
    """The top 20 of a list that is maintained for 5 has 5 entries."""
    return state.top_k(simple_spam(spark, sf_dir).groupBy("sender").agg(F.count(F.lit(1)).alias("cnt")), TOP, "cnt", "sender", most=5)


@query("v AS (SELECT sender, ts, max(ts) FILTER (ts <= 1705276800000) OVER (PARTITION BY sender) AS newest FROM messages) SELECT:: sender, ts FROM v WHERE ts > 1705276800000 OR ts = newest")
def state_after_collection(spark, sf_dir):
    """Versions that a read from the middle of the month on can still see."""
    return state.forget_before(ev.messages(spark, sf_dir).select("sender", "ts"), ["sender"], ev.FIRST_PROBE + days(14))


@query("v AS (SELECT sender, ts, max(recipient) % 3 AS v FROM messages GROUP BY sender, ts), w AS (SELECT *, lag(v) OVER (PARTITION BY sender ORDER BY ts) AS before, row_number() OVER (PARTITION BY sender ORDER BY ts) AS k FROM v) SELECT:: sender, ts, v FROM w WHERE k = 1 OR v IS DISTINCT FROM before")
def compacted_ledger(spark, sf_dir):
    """Each sender's values without repeats of the value before."""
    v = ev.messages(spark, sf_dir).groupBy("sender", "ts").agg((F.max("recipient") % 3).alias("v"))
    return state.compact(state.settled(v), ["sender"], "v")


@query("SELECT:: sender, ts, message_id FROM messages")
def split_round_robin(spark, sf_dir):
    """Messages written to four files by turns and read back."""
    path = files.scratch_path(spark, "round-robin")
    files.write_round_robin(ev.messages(spark, sf_dir).select("sender", "ts", "message_id"), path, 4)
    return files.read_events(spark, path)


@query("SELECT:: sender, ts, message_id, CAST(sender % 4 AS INTEGER) AS low FROM messages")
def split_by_key(spark, sf_dir):
    """Messages written to four folders by their senders' hash and read back, each with its sender's remainder."""
    path = files.scratch_path(spark, "by-key")
    files.write_by_key(ev.messages(spark, sf_dir).select("sender", "ts", "message_id"), path, 4, "sender")
    return files.read_events(spark, path).select("sender", "ts", "message_id", (F.col("sender") % 4).cast("int").alias("low"))


@query(f"{_ACCESS} SELECT:: CAST(floor((dst_ts - 1704067200000) / 86400000) AS BIGINT) AS batch, count(*) AS edges FROM edges GROUP BY ALL")
def causal_edge_batches(spark, sf_dir):
    """Edges by the day of their end."""
    return causal.batch_edges(_edges(spark, sf_dir), ev.FIRST_PROBE, days(1)).groupBy("batch").agg(F.count(F.lit(1)).alias("edges"))


def _logs(spark, sf_dir):
    """Run logs made from customers' numbers: a name, a timing text and a performance text each."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("c"))
    number = lambda e: e.cast("string")
    name = F.concat(F.lit("ab-"), number(F.col("c") % 7), F.lit("-"), number(F.col("c") % 5 + 1), F.lit("-"), number(F.col("c") % 3), F.lit("-spam.Simple-true-500-"), F.lit("2.5.timing"))
    text = F.concat(F.lit("start\nreal    "), number(F.col("c") % 4), F.lit("m"), number(F.col("c") % 60), F.lit("."), number(F.col("c") % 900 + 100), F.lit("s\n"), F.when(F.col("c") % 11 == 0, "java.lang.Exception").otherwise("done"))
    perf = F.concat(F.lit("reader thread time "), number(F.col("c") % 50), F.lit(" ms\nthread 3 (phase 2) finished with elapsed cpu time "), number(F.col("c") % 70), F.lit(" ms\nsent_bytes="), number(F.col("c")), F.lit(" recv_bytes=7"))
    return c.select("c", name.alias("name"), text.alias("text"), perf.alias("perf"))


@query("SELECT CAST(c_custkey % 7 AS INTEGER) AS hosts, CAST(c_custkey % 5 + 1 AS INTEGER) AS partitions, CAST(c_custkey % 3 AS INTEGER) AS iteration, 2.5::DOUBLE AS alpha, 500 AS batchsize, 'spam.Simple' AS detector, CAST((c_custkey % 4) * 60000 + (c_custkey % 60) * 1000 + c_custkey % 900 + 100 AS BIGINT) AS overall_ms FROM customer WHERE c_custkey % 11 <> 0")
def run_timings(spark, sf_dir):
    """Runs out of timing files; those that failed are left out."""
    return stats.parse_timings(_logs(spark, sf_dir)).drop("uuid")


@query("WITH l AS (SELECT c_custkey % 7 AS run, c_custkey AS c FROM customer) SELECT run, CAST(sum(c % 50) AS BIGINT) AS reader_thread_ms, CAST(sum(c % 70) AS BIGINT) AS phase_threads_ms, CAST(sum(c) AS BIGINT) AS sent, CAST(sum(7) AS BIGINT) AS received, round(max(c) * count(*) FILTER (c > 0) / sum(c), 6) AS sent_skew FROM l GROUP BY run")
def run_performance(spark, sf_dir):
    """Sums of the figures of each run's performance files."""
    logs = _logs(spark, sf_dir).select((F.col("c") % 7).alias("run"), F.col("perf").alias("text"))
    out = stats.summarise_perf(logs)
    return out.select("run", "reader_thread_ms", "phase_threads_ms", F.col("kryo_send_bytes").alias("sent"), F.col("kryo_recv_bytes").alias("received"), F.round("kryo_send_skew", 6).alias("sent_skew"))


@query("SELECT 'uniform' AS kind, true AS in_order, true AS users_in_range, true AS both_kinds, true AS pairs_once UNION ALL SELECT 'tunable', true, true, true, true")
def generated_events(spark, sf_dir):
    """What must hold of generated events, whatever the seed gives; a pair's friendship comes once from the tunable source."""
    parts = []
    for kind, rows in (("uniform", generators.uniform_events(spark, 500, 5000)), ("tunable", generators.tunable_events(spark, 500, 5000))):
        rows = state.settled(rows)
        friend, u, v = F.col("kind") == "friendship", F.least("user_a", "user_b"), F.greatest("user_a", "user_b")
        once = F.lit(True) if kind == "uniform" else F.count(F.when(friend, 1)) == F.countDistinct(F.when(friend, F.struct(u, v)))
        parts.append(rows.agg(F.lit(kind).alias("kind"), (F.min("ts") >= generators.START).alias("in_order"), ((F.min(u) >= 0) & (F.max(v) < 500)).alias("users_in_range"), (F.countDistinct("kind") == 2).alias("both_kinds"), once.alias("pairs_once")))
    return parts[0].unionByName(parts[1])
