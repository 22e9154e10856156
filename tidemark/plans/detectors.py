"""Message spam: the simple, address and full detectors, their parts, and their variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.durations import days, minutes
from ..functions.text import contains_email, has_email, pair_key
from ..operators import state
from ..sources import events as ev
from .registry import query

#: Time that one task takes of one key's rows in running reads.
SPLIT = days(7)
# The detectors' thresholds.
LEAST_SENT, EMAIL_BY_IP, EMAIL_SHARE, RECENT_SHARE, RESPONSE_SHARE = 5, 0.2, 0.5, 0.2, 0.1
NONFRIENDS, RECIPIENTS, TOP, SCORE = 7, 5, 20, 10


def friends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lo, hi, since: the first friendship of each unordered pair."""
    f = ev.friendships(spark, sf_dir)
    lo, hi = pair_key(F.col("user_a"), F.col("user_b"))
    return f.groupBy(lo.alias("lo"), hi.alias("hi")).agg(F.min("ts").alias("since"))


def flagged(spark: SparkSession, sf_dir: str, strict: bool = False) -> DataFrame:
    """Messages with is_friend: whether the pair were friends by then (before then, if strict).

    Friendship never ends, so the read is an equality join with each pair's first time. Spark broadcasts the pairs
    if they are small and splits skewed pairs otherwise.
    """
    m = ev.messages(spark, sf_dir)
    lo, hi = pair_key(F.col("sender"), F.col("recipient"))
    since = F.col("since") < F.col("ts") if strict else F.col("since") <= F.col("ts")
    return m.withColumns({"lo": lo, "hi": hi}).join(friends(spark, sf_dir), ["lo", "hi"], "left").withColumn("is_friend", F.coalesce(since, F.lit(False))).drop("lo", "hi", "since")


def counted(spark: SparkSession, sf_dir: str, strict: bool = False) -> DataFrame:
    """Messages with f and nf: the sender's messages to friends and others so far, this one included.

    What the text is asked for is asked right after the scan: ``mail`` goes on, the content does not.
    """
    m = flagged(spark, sf_dir, strict).select("ts", "message_id", "sender", "sender_ip", has_email(F.col("content")).alias("mail"), "is_friend")
    friend = F.col("is_friend").cast("long")
    return state.running(m, ["sender"], {"f": ("sum", friend), "nf": ("sum", 1 - friend)}, split_ms=SPLIT, settle=True)


def is_simple_spam(f="f", nf="nf"):
    return (F.col(nf) > 2 * F.col(f)) & (F.col(f) + F.col(nf) > LEAST_SENT)


def simple_spam(spark: SparkSession, sf_dir: str, strict: bool = False) -> DataFrame:
    return counted(spark, sf_dir, strict).where(is_simple_spam())


_COUNTED = """counted AS (
  SELECT *, sum(CASE WHEN is_friend THEN 1 ELSE 0 END) OVER w AS f, sum(CASE WHEN is_friend THEN 0 ELSE 1 END) OVER w AS nf
  FROM flagged WINDOW w AS (PARTITION BY sender ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
simple AS (SELECT * FROM counted WHERE nf > 2 * f AND f + nf > 5)"""
_RULES = """rule1 AS (SELECT message_id FROM simple),
rule2 AS (SELECT message_id FROM (SELECT message_id, is_friend, count(*) FILTER (NOT is_friend) OVER w AS n, list(recipient) FILTER (NOT is_friend) OVER w AS r
  FROM flagged WINDOW w AS (PARTITION BY sender ORDER BY ts RANGE BETWEEN 7199999 PRECEDING AND CURRENT ROW)) WHERE n > 7 AND len(list_distinct(r)) > 5),
rule3 AS (SELECT message_id FROM (SELECT message_id, count(*) FILTER (regexp_matches(content, '\\b[A-z0-9._%+-]+@[A-z0-9.-]+\\.[A-z]{2,}\\b')) OVER w AS e, count(*) OVER w AS n
  FROM messages WINDOW w AS (PARTITION BY sender ORDER BY ts RANGE BETWEEN 2591999999 PRECEDING AND CURRENT ROW)) WHERE e / n > 0.5),
rule4 AS (SELECT message_id FROM (SELECT message_id, ts, min(ts) OVER (PARTITION BY sender ORDER BY ts) AS first_ts,
    count(*) OVER (PARTITION BY sender ORDER BY ts RANGE BETWEEN 86399999 PRECEDING AND CURRENT ROW) AS d1,
    count(*) OVER (PARTITION BY sender ORDER BY ts RANGE BETWEEN 604799999 PRECEDING AND CURRENT ROW) AS d7 FROM messages)
  WHERE first_ts > ts - 604800000 AND d1 / d7 > 0.2),
answered AS (SELECT m.*, (SELECT max(b.ts) FROM messages b WHERE b.sender = m.recipient AND b.recipient = m.sender AND b.ts <= m.ts) AS last_back FROM messages m),
responses AS (SELECT *, sum(CASE WHEN last_back IS NOT NULL AND last_back > ts - 604800000 THEN 1 ELSE 0 END) OVER w AS r, count(*) OVER w AS n
  FROM answered WINDOW w AS (PARTITION BY sender ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
rule5 AS (SELECT message_id FROM responses WHERE r / n < 0.1)"""
_SCORES = """scores AS (SELECT message_id, CAST(10 * count(*) AS BIGINT) AS score FROM (
  SELECT * FROM rule1 UNION ALL SELECT * FROM rule3 UNION ALL SELECT * FROM rule4 UNION ALL SELECT * FROM rule5) GROUP BY message_id)"""
_IP = """by_ip AS (SELECT *, sum(CASE WHEN content LIKE '%@%' THEN 1 ELSE 0 END) OVER w AS email, sum(CASE WHEN content LIKE '%@%' THEN 0 ELSE 1 END) OVER w AS noemail
  FROM messages WINDOW w AS (PARTITION BY sender_ip ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query("SELECT:: message_id, is_friend FROM flagged")
def friend_flag_asof(spark, sf_dir):
    return flagged(spark, sf_dir).select("message_id", "is_friend")


@query("SELECT:: m.message_id, f.since IS NOT NULL AND f.since < m.ts AS is_friend FROM messages m LEFT JOIN friends f ON f.lo = least(m.sender, m.recipient) AND f.hi = greatest(m.sender, m.recipient)")
def friend_flag_strict(spark, sf_dir):
    return flagged(spark, sf_dir, strict=True).select("message_id", "is_friend")


@query(f"{_COUNTED} SELECT:: message_id, CAST(f AS BIGINT) AS f, CAST(nf AS BIGINT) AS nf FROM counted")
def sender_friend_counts(spark, sf_dir):
    return counted(spark, sf_dir).select("message_id", "f", "nf")


@query(f"{_COUNTED} SELECT:: message_id, sender, ts FROM simple")
def simple_spam_messages(spark, sf_dir):
    return simple_spam(spark, sf_dir).select("message_id", "sender", "ts")


@query(f"{_COUNTED} SELECT:: count(*) AS n FROM simple")
def simple_spam_count(spark, sf_dir):
    return simple_spam(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))


@query(f"{_COUNTED} SELECT:: count(DISTINCT sender) AS n FROM simple")
def simple_spam_users(spark, sf_dir):
    return simple_spam(spark, sf_dir).agg(F.countDistinct("sender").alias("n"))


@query(f"{_COUNTED} SELECT:: sender, count(*) AS cnt FROM simple GROUP BY sender ORDER BY cnt DESC, sender LIMIT 20")
def simple_top20_spammers(spark, sf_dir):
    return state.top_k(simple_spam(spark, sf_dir).groupBy("sender").agg(F.count(F.lit(1)).alias("cnt")), TOP, "cnt", "sender")


@query(f"{_COUNTED}, snap AS (SELECT p.probe_ts, s.sender, count(*) AS cnt FROM probes p JOIN simple s ON s.ts <= p.probe_ts GROUP BY ALL) SELECT:: probe_ts, sender, cnt FROM snap QUALIFY row_number() OVER (PARTITION BY probe_ts ORDER BY cnt DESC, sender) <= 20")
def top_spammers_asof(spark, sf_dir):
    found = state.running_at_probes(simple_spam(spark, sf_dir).withColumn("one", F.lit(1)), ev.probe_times(spark, sf_dir), {"cnt": F.col("one")}, ("sender",)).where("cnt > 0")
    return state.top_k(found, TOP, "cnt", "sender", ("probe_ts",))


@query("SELECT:: p.probe_ts, count(*) FILTER (m.is_friend) AS friend, count(*) FILTER (NOT m.is_friend) AS nonfriend FROM probes p LEFT JOIN flagged m ON m.ts <= p.probe_ts GROUP BY p.probe_ts")
def global_friend_counters_asof(spark, sf_dir):
    friend = F.col("is_friend").cast("long")
    return state.running_at_probes(flagged(spark, sf_dir), ev.probe_times(spark, sf_dir), {"friend": friend, "nonfriend": 1 - friend})


@query("totals AS (SELECT message_id, sum(CASE WHEN is_friend THEN 1 ELSE 0 END) OVER w AS friend, count(*) OVER w AS total FROM flagged WINDOW w AS (ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT:: message_id, CAST(friend AS BIGINT) AS friend, total FROM totals")
def global_running_counters(spark, sf_dir):
    out = state.running_total(flagged(spark, sf_dir), {"friend": ("sum", F.col("is_friend").cast("long")), "total": ("count", F.lit(1))}, days(1))
    return out.select("message_id", "friend", "total")


@query(f"{_COUNTED} SELECT:: p.probe_ts, count(DISTINCT s.sender) AS n FROM probes p LEFT JOIN simple s ON s.ts <= p.probe_ts GROUP BY p.probe_ts")
def distinct_spam_users_asof(spark, sf_dir):
    first = simple_spam(spark, sf_dir).groupBy("sender").agg(F.min("ts").alias("ts"))
    return state.running_at_probes(first, ev.probe_times(spark, sf_dir), {"n": F.lit(1)})


def by_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with the running counts of their address' messages with and without an e-mail address in them."""
    mail = has_email(F.col("content")).cast("long")
    return state.running(ev.messages(spark, sf_dir), ["sender_ip"], {"email": ("sum", mail), "noemail": ("sum", 1 - mail)}, split_ms=days(1))


@query(f"{_IP} SELECT:: message_id, CAST(email AS BIGINT) AS email, CAST(noemail AS BIGINT) AS noemail FROM by_ip")
def ip_email_ratio(spark, sf_dir):
    return by_address(spark, sf_dir).select("message_id", "email", "noemail")


def address_spam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple spam from addresses of which over a fifth of the messages hold an e-mail address: columns of one row."""
    mail = F.col("mail").cast("long")
    m = counted(spark, sf_dir)
    both = state.running(m, ["sender_ip"], {"email": ("sum", mail), "noemail": ("sum", 1 - mail)}, split_ms=days(1), settle=True)
    return both.where(is_simple_spam() & (F.col("email") / (F.col("email") + F.col("noemail")) > EMAIL_BY_IP))


@query(f"{_COUNTED}, {_IP} SELECT:: s.message_id FROM simple s JOIN by_ip i USING (message_id) WHERE i.email / (i.email + i.noemail) > 0.2")
def ip_spam_messages(spark, sf_dir):
    return address_spam(spark, sf_dir).select("message_id")


@query(f"{_COUNTED}, {_IP} SELECT:: message_id FROM simple INTERSECT SELECT message_id FROM by_ip WHERE email / (email + noemail) > 0.2")
def ip_spam_intersection(spark, sf_dir):
    """The same messages as a set operation between the two detectors."""
    mail = by_address(spark, sf_dir).where(F.col("email") / (F.col("email") + F.col("noemail")) > EMAIL_BY_IP)
    return simple_spam(spark, sf_dir).select("message_id").intersect(mail.select("message_id"))


@query(f"{_COUNTED}, {_RULES} SELECT:: message_id FROM rule1")
def rule1(spark, sf_dir):
    return simple_spam(spark, sf_dir).select("message_id")


@query(f"{_RULES.replace('rule1 AS (SELECT message_id FROM simple),', '')} SELECT:: message_id FROM rule2")
def rule2_nonfriend_burst(spark, sf_dir):
    """Over 7 messages to others in 120 minutes, to over 5 of them."""
    return nonfriend_bursts(flagged(spark, sf_dir)).select("message_id")


def nonfriend_bursts(m: DataFrame) -> DataFrame:
    """The messages at which rule 2 fires; a recipient counts while their last message from the sender is in the window."""
    other = F.when(~F.col("is_friend"), F.col("recipient"))
    w = state.sliding(m.select("ts", "message_id", "sender", "recipient", "is_friend"), ["sender"], {"n": ("count", other, minutes(120)), "who": ("distinct", other, minutes(120))})
    return w.where((F.col("n") > NONFRIENDS) & (F.col("who") > RECIPIENTS))


_DENSE = "dense AS (SELECT * REPLACE (1704067200000 + (ts - 1704067200000) // 60 AS ts, sender % 10 AS sender) FROM flagged), rule2 AS (SELECT message_id FROM (SELECT message_id, count(*) FILTER (NOT is_friend) OVER w AS n, list(recipient) FILTER (NOT is_friend) OVER w AS r FROM dense WINDOW w AS (PARTITION BY sender ORDER BY ts RANGE BETWEEN 7199999 PRECEDING AND CURRENT ROW)) WHERE n > 7 AND len(list_distinct(r)) > 5)"


@query(f"{_DENSE} SELECT:: message_id FROM rule2")
def rule2_in_dense_traffic(spark, sf_dir):
    """Rule 2 over the same messages in a sixtieth of their time and from ten senders, where bursts are common."""
    start = F.lit(ev.FIRST_PROBE)
    dense = flagged(spark, sf_dir).withColumns({"ts": start + F.floor((F.col("ts") - start) / 60), "sender": F.col("sender") % 10})
    return nonfriend_bursts(dense).select("message_id")


def _recent() -> dict:
    """The sliding counts that rules 3 and 4 look at; ``mail`` tells whether a message holds an address."""
    one, mail = F.count(F.lit(1)), F.count(F.when(F.col("mail"), 1))
    return {"e30": (mail, days(30)), "n30": (one, days(30)), "d1": (one, days(1)), "d7": (one, days(7))}


def _is_mail_heavy():
    return F.col("e30") / F.col("n30") > EMAIL_SHARE


def with_recent(messages: DataFrame, *names: str) -> DataFrame:
    """Messages with some of the sliding counts of their sender, from one shuffle dealt by sender and time."""
    return state.sliding(messages, ["sender"], {n: w for n, w in _recent().items() if n in names})


def asked_for_mail(messages: DataFrame) -> DataFrame:
    """Messages with ``mail`` in the place of their content."""
    return messages.withColumn("mail", contains_email(F.col("content"))).drop("content")


def with_first(messages: DataFrame) -> DataFrame:
    """Messages with the time of their sender's first message: small totals, joined by sender."""
    return messages.join(messages.groupBy("sender").agg(F.min("ts").alias("first_ts")), "sender")


@query(f"{_RULES.replace('rule1 AS (SELECT message_id FROM simple),', '')} SELECT:: message_id FROM rule3")
def rule3_email_share(spark, sf_dir):
    return with_recent(asked_for_mail(ev.messages(spark, sf_dir)), "e30", "n30").where(_is_mail_heavy()).select("message_id")


def _rampup(documented: bool = False):
    young = F.col("first_ts") > F.col("ts") - days(7)
    return (~young if documented else young) & (F.col("d1") / F.col("d7") > RECENT_SHARE)


@query(f"{_RULES.replace('rule1 AS (SELECT message_id FROM simple),', '')} SELECT:: message_id FROM rule4")
def rule4_ramp_up(spark, sf_dir):
    return with_first(with_recent(ev.messages(spark, sf_dir), "d1", "d7")).where(_rampup()).select("message_id")


@query("w AS (SELECT message_id, ts, min(ts) OVER (PARTITION BY sender ORDER BY ts) AS first_ts, count(*) OVER (PARTITION BY sender ORDER BY ts RANGE BETWEEN 86399999 PRECEDING AND CURRENT ROW) AS d1, count(*) OVER (PARTITION BY sender ORDER BY ts RANGE BETWEEN 604799999 PRECEDING AND CURRENT ROW) AS d7 FROM messages) SELECT:: message_id FROM w WHERE first_ts <= ts - 604800000 AND d1 / d7 > 0.2")
def rule4_ramp_up_documented(spark, sf_dir):
    """Rule 4 as its description has it: for senders of more than seven days."""
    return with_first(with_recent(ev.messages(spark, sf_dir), "d1", "d7")).where(_rampup(True)).select("message_id")


def with_last_contact(messages: DataFrame, settle: bool = False) -> DataFrame:
    """Messages with last_back: when the recipient last wrote to the sender, up to now; one window over the pair."""
    lo, hi = pair_key(F.col("sender"), F.col("recipient"))
    m = messages.withColumns({"lo": lo, "hi": hi})
    aggs = {"lo_wrote": ("max", F.when(F.col("sender") == F.col("lo"), F.col("ts"))), "hi_wrote": ("max", F.when(F.col("sender") == F.col("hi"), F.col("ts")))}
    seen = state.running(m, ["lo", "hi"], aggs, split_ms=SPLIT, settle=settle)
    return seen.withColumn("last_back", F.when(F.col("recipient") == F.col("lo"), F.col("lo_wrote")).otherwise(F.col("hi_wrote"))).drop("lo", "hi", "lo_wrote", "hi_wrote")


def with_responses(messages: DataFrame) -> DataFrame:
    answer = F.coalesce(F.col("last_back") > F.col("ts") - days(7), F.lit(False)).cast("long")
    m = with_last_contact(messages.select("ts", "message_id", "sender", "recipient"))
    return state.running(m, ["sender"], {"r": ("sum", answer), "n": ("count", F.lit(1))}, split_ms=SPLIT, settle=True)


@query(f"{_RULES.replace('rule1 AS (SELECT message_id FROM simple),', '')} SELECT:: message_id FROM rule5")
def rule5_few_responses(spark, sf_dir):
    return with_responses(ev.messages(spark, sf_dir)).where(F.col("r") / F.col("n") < RESPONSE_SHARE).select("message_id")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with the full detector's score, 10 for each of rules 1, 3, 4 and 5: columns added to one row.

    Events are scanned once for each kind; what a read uses twice is a table by then.
    """
    friend = F.col("is_friend").cast("long")
    answer = F.coalesce(F.col("last_back") > F.col("ts") - days(7), F.lit(False)).cast("long")
    m = with_last_contact(asked_for_mail(flagged(spark, sf_dir)), settle=True)
    m = state.running(m, ["sender"], {"f": ("sum", friend), "nf": ("sum", 1 - friend), "r": ("sum", answer), "first_ts": ("min", F.col("ts"))}, split_ms=SPLIT, settle=True)
    m = with_recent(m, "e30", "n30", "d1", "d7")
    fires = [is_simple_spam(), _is_mail_heavy(), _rampup(), F.col("r") / (F.col("f") + F.col("nf")) < RESPONSE_SHARE]
    return m.withColumn("score", sum((F.when(c, SCORE).otherwise(0) for c in fires), F.lit(0)).cast("long"))


@query(f"{_COUNTED}, {_RULES}, {_SCORES} SELECT:: message_id, score FROM scores")
def full_spam_score(spark, sf_dir):
    return scored(spark, sf_dir).where(F.col("score") >= SCORE).select("message_id", "score")


@query(f"{_COUNTED}, {_RULES}, {_SCORES} SELECT:: count(*) AS n FROM scores")
def full_spam_count(spark, sf_dir):
    return scored(spark, sf_dir).where(F.col("score") >= SCORE).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT:: message_id, sender, count(*) OVER (PARTITION BY sender ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cnt FROM messages")
def message_count_running(spark, sf_dir):
    return state.running(ev.messages(spark, sf_dir), ["sender"], {"cnt": ("count", F.lit(1))}, split_ms=SPLIT).select("message_id", "sender", "cnt")


@query("SELECT:: count(*) AS n FROM (SELECT count(*) OVER (PARTITION BY sender ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cnt FROM messages) WHERE cnt = 9")
def message_count_threshold9(spark, sf_dir):
    return message_count_running(spark, sf_dir).where("cnt = 9").agg(F.count(F.lit(1)).alias("n"))


_ARRIVAL = """legacy AS (SELECT *, sum(CASE WHEN is_friend THEN 1 ELSE 0 END) OVER w AS f, sum(CASE WHEN is_friend THEN 0 ELSE 1 END) OVER w AS nf
  FROM flagged WINDOW w AS (PARTITION BY sender ORDER BY ts, message_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query(f"{_ARRIVAL} SELECT:: sender, count(*) FILTER (nf > 5 AND nf > f) AS spam, count(*) FILTER (is_friend) AS friend, count(*) FILTER (NOT is_friend) AS nonfriend FROM legacy GROUP BY sender HAVING count(*) FILTER (nf > 5 AND nf > f) > 0")
def legacy_spam_report(spark, sf_dir):
    """The older detector, in order of arrival: over 5 messages to others and more than to friends."""
    friend = F.col("is_friend").cast("long")
    m = flagged(spark, sf_dir).select("ts", "message_id", "sender", "is_friend")
    m = state.running(m, ["sender"], {"f": ("sum", friend), "nf": ("sum", 1 - friend)}, split_ms=SPLIT, ties="rows", tiebreak=("message_id",), settle=True)
    spam = F.count(F.when((F.col("nf") > 5) & (F.col("nf") > F.col("f")), 1))
    return m.groupBy("sender").agg(spam.alias("spam"), F.sum(friend).alias("friend"), F.sum(1 - friend).alias("nonfriend")).where("spam > 0")


def batch_of(ts, width_ms: int = days(1), start: int = ev.FIRST_PROBE):
    return F.floor((ts - start) / width_ms)


_LAG = """batched AS (SELECT m.*, CAST(floor((m.ts - 1704067200000) / 86400000) AS BIGINT) AS batch, f.since FROM messages m LEFT JOIN friends f ON f.lo = least(m.sender, m.recipient) AND f.hi = greatest(m.sender, m.recipient)),
stale AS (SELECT *, since IS NOT NULL AND floor((since - 1704067200000) / 86400000) < batch AS knew FROM batched),
sums AS (SELECT sender, batch, sum(CASE WHEN knew THEN 1 ELSE 0 END) AS f, sum(CASE WHEN knew THEN 0 ELSE 1 END) AS nf FROM stale GROUP BY ALL),
past AS (SELECT sender, batch, coalesce(sum(f) OVER w, 0) AS f, coalesce(sum(nf) OVER w, 0) AS nf FROM sums WINDOW w AS (PARTITION BY sender ORDER BY batch RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lagged AS (SELECT s.*, p.f, p.nf FROM stale s JOIN past p USING (sender, batch) WHERE p.nf > 2 * p.f AND p.f + p.nf > 5)"""
_LAG_IP = """ip_sums AS (SELECT sender_ip, batch, count(*) FILTER (content LIKE '%@%') AS e, count(*) AS n FROM stale GROUP BY ALL),
ip_past AS (SELECT sender_ip, batch, coalesce(sum(e) OVER w, 0) AS e, coalesce(sum(n) OVER w, 0) AS n FROM ip_sums WINDOW w AS (PARTITION BY sender_ip ORDER BY batch RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def lagged_simple(spark: SparkSession, sf_dir: str, width_ms: int = days(1)) -> DataFrame:
    """Messages judged by friendships and counts of earlier batches alone."""
    lo, hi = pair_key(F.col("sender"), F.col("recipient"))
    m = ev.messages(spark, sf_dir).withColumns({"lo": lo, "hi": hi, "batch": batch_of(F.col("ts"), width_ms)})
    m = m.join(friends(spark, sf_dir), ["lo", "hi"], "left").withColumn("knew", F.coalesce(batch_of(F.col("since"), width_ms) < F.col("batch"), F.lit(False)).cast("long"))
    return state.lagged(m, ["sender"], "batch", {"f": F.col("knew"), "nf": 1 - F.col("knew")}).where(is_simple_spam())


@query(f"{_LAG} SELECT:: batch, count(*) AS n FROM lagged GROUP BY batch")
def lagged_batch_simple(spark, sf_dir):
    return lagged_simple(spark, sf_dir).groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_LAG}, {_LAG_IP} SELECT:: l.batch, count(*) AS n FROM lagged l JOIN ip_past i USING (sender_ip, batch) WHERE i.n > 0 AND i.e / i.n > 0.2 GROUP BY l.batch")
def lagged_batch_ip(spark, sf_dir):
    m = ev.messages(spark, sf_dir).withColumn("batch", batch_of(F.col("ts")))
    mail = F.when(has_email(F.col("content")), 1).otherwise(0)
    per_ip = m.groupBy("sender_ip", "batch").agg(F.sum(mail).alias("e0"), F.count(F.lit(1)).alias("n0"))
    past = state.lagged(per_ip, ["sender_ip"], "batch", {"e": F.col("e0"), "n": F.col("n0")}).where("n > 0 and e / n > 0.2").select("sender_ip", "batch")
    return lagged_simple(spark, sf_dir).join(past, ["sender_ip", "batch"]).groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_COUNTED} SELECT:: CAST(floor((ts - 1704067200000) / 86400000) AS BIGINT) AS batch, count(*) AS n FROM simple GROUP BY ALL")
def exact_batch_simple(spark, sf_dir):
    """Per-batch counts that add up to the full replay, by carried totals of batches."""
    friend = F.col("is_friend").cast("long")
    m = flagged(spark, sf_dir).select("ts", "message_id", "sender", "is_friend")
    m = state.running(m, ["sender"], {"f": ("sum", friend), "nf": ("sum", 1 - friend)}, split_ms=days(1), settle=True)
    return m.where(is_simple_spam()).groupBy(batch_of(F.col("ts")).alias("batch")).agg(F.count(F.lit(1)).alias("n"))


@query("cut AS (SELECT (min(ts) + max(ts)) // 2 AS ts FROM messages), d AS (SELECT sender, m.ts > cut.ts AS late, count(*) AS n FROM messages m, cut GROUP BY ALL) SELECT:: coalesce(a.sender, b.sender) AS sender, CAST(coalesce(a.n, 0) + coalesce(b.n, 0) AS BIGINT) AS n FROM (SELECT * FROM d WHERE NOT late) a FULL JOIN (SELECT * FROM d WHERE late) b ON a.sender = b.sender")
def full_outer_state_merge(spark, sf_dir):
    """Counts of the second half of the time added into the state of the first."""
    m = ev.messages(spark, sf_dir)
    ends = m.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    cut = 0 if ends.a is None else (ends.a + ends.b) // 2
    counts = lambda rows: rows.groupBy("sender").agg(F.count(F.lit(1)).alias("n"))
    return state.merge_state(counts(m.where(F.col("ts") <= cut)), counts(m.where(F.col("ts") > cut)), ["sender"], ["n"])
