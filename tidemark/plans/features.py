"""Product popularity, responses, and the features that the design notes name."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.durations import days
from ..operators import state
from ..sources import events as ev
from ..sources.files import scratch_path
from .detectors import flagged, with_last_contact, with_responses
from .registry import query

QUERY_BLOCK = 4096


@query("v AS (SELECT event_id, count(*) OVER (PARTITION BY sku ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS views, count(*) OVER (ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM product_views) SELECT:: event_id, views, total, round(views / total, 6) AS popularity FROM v")
def popularity(spark, sf_dir):
    """At each view: the product's views and all views so far."""
    v = state.running(ev.product_views(spark, sf_dir), ["sku"], {"views": ("count", F.lit(1))}, split_ms=days(7))
    v = state.running_total(v, {"total": ("count", F.lit(1))}, days(1), settle=True)
    return v.select("event_id", "views", "total", F.round(F.col("views") / F.col("total"), 6).alias("popularity"))


@query("v AS (SELECT sku, ts FROM product_views) SELECT:: u.event_id, (SELECT count(*) FROM v WHERE v.sku = u.sku AND v.ts <= u.ts) AS views FROM product_updates u")
def popularity_at_updates(spark, sf_dir):
    """At each update of a product: its views so far, read from the other stream."""
    views = ev.product_views(spark, sf_dir).select("sku", "ts", F.lit(1).alias("one"))
    read = state.asof_running(ev.product_updates(spark, sf_dir), views, ["sku"], {"views": ("count", "one")}, split_ms=days(7))
    return read.select("event_id", F.coalesce("views", F.lit(0)).alias("views"))


_BACK = "answered AS (SELECT m.*, (SELECT max(b.ts) FROM messages b WHERE b.sender = m.recipient AND b.recipient = m.sender AND b.ts <= m.ts) AS last_back FROM messages m)"


@query(f"{_BACK} SELECT:: message_id, last_back FROM answered")
def last_contact(spark, sf_dir):
    return with_last_contact(ev.messages(spark, sf_dir)).select("message_id", "last_back")


@query(f"{_BACK} SELECT:: message_id, CAST(sum(ts - last_back) OVER w AS BIGINT) AS waited, count(last_back) OVER w AS responses FROM answered WINDOW w AS (PARTITION BY sender ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def avg_response_time(spark, sf_dir):
    """Sum and number of the sender's waits so far; their quotient is the mean. Null before the first response."""
    m = with_last_contact(ev.messages(spark, sf_dir).select("ts", "message_id", "sender", "recipient"))
    out = state.running(m, ["sender"], {"waited": ("sum", F.col("ts") - F.col("last_back")), "responses": ("count", F.col("last_back"))}, split_ms=days(7), settle=True)
    return out.select("message_id", F.when(F.col("responses") > 0, F.col("waited")).alias("waited"), "responses")


@query(f"{_BACK} SELECT:: message_id, round(count(last_back) OVER w / count(*) OVER w, 6) AS fraction FROM answered WINDOW w AS (PARTITION BY sender ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def response_fraction(spark, sf_dir):
    m = with_last_contact(ev.messages(spark, sf_dir).select("ts", "message_id", "sender", "recipient"))
    out = state.running(m, ["sender"], {"r": ("count", F.col("last_back")), "n": ("count", F.lit(1))}, split_ms=days(7), settle=True)
    return out.select("message_id", F.round(F.col("r") / F.col("n"), 6).alias("fraction"))


@query(f"{_BACK} SELECT:: sender, count(*) FILTER (last_back > ts - 86400000) AS within_day, count(*) AS n FROM answered GROUP BY sender")
def responses_within_day(spark, sf_dir):
    m = with_last_contact(ev.messages(spark, sf_dir))
    return m.groupBy("sender").agg(F.count(F.when(F.col("last_back") > F.col("ts") - days(1), 1)).alias("within_day"), F.count(F.lit(1)).alias("n"))


@query("SELECT:: sender, count(*) AS conversations FROM (SELECT sender, recipient, ts, lag(ts) OVER (PARTITION BY least(sender, recipient), greatest(sender, recipient) ORDER BY ts, message_id) AS before FROM messages) WHERE before IS NULL OR before <= ts - 604800000 GROUP BY sender")
def conversations_initiated(spark, sf_dir):
    """Messages to someone with whom nothing was exchanged for seven days; a pair's time is dealt in parts."""
    m = ev.messages(spark, sf_dir).select("ts", "message_id", "sender", F.least("sender", "recipient").alias("lo"), F.greatest("sender", "recipient").alias("hi"))
    m = state.running(m, ["lo", "hi"], {"before": ("max", F.col("ts"))}, strict=True, split_ms=days(7), ties="rows", tiebreak=("message_id",))
    return m.where(F.col("before").isNull() | (F.col("before") <= F.col("ts") - days(7))).groupBy("sender").agg(F.count(F.lit(1)).alias("conversations"))


@query("SELECT:: message_id, row_number() OVER (PARTITION BY sender, sender_ip ORDER BY ts, message_id) = 1 AS new_address FROM messages")
def new_address(spark, sf_dir):
    m = state.mark_first(ev.messages(spark, sf_dir), ["sender", "sender_ip"], "new")
    return m.select("message_id", (F.col("new") == 1).alias("new_address"))


@query("r AS (SELECT *, row_number() OVER (PARTITION BY sender, recipient ORDER BY ts, message_id) AS k FROM messages) SELECT:: message_id, CAST(sum(CASE WHEN k = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY sender ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS recipients FROM r")
def distinct_recipients_so_far(spark, sf_dir):
    m = state.mark_first(ev.messages(spark, sf_dir), ["sender", "recipient"], "new")
    m = m.select("ts", "message_id", "sender", "new")
    return state.running(m, ["sender"], {"recipients": ("sum", F.col("new"))}, split_ms=days(7), settle=True).select("message_id", "recipients")


@query("SELECT:: sender, count(*) FILTER (is_friend) AS to_friends, count(*) AS n FROM flagged GROUP BY sender")
def messages_to_friends(spark, sf_dir):
    return flagged(spark, sf_dir).groupBy("sender").agg(F.count(F.when(F.col("is_friend"), 1)).alias("to_friends"), F.count(F.lit(1)).alias("n"))


_COSINE = "q AS (SELECT vec_id AS q, embedding AS e FROM embeddings WHERE vec_id % 50 = 0) SELECT:: q.q AS query_id, d.vec_id, round(CAST(list_cosine_similarity(CAST(q.e AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])) AS DOUBLE), 6) AS cos FROM q JOIN embeddings d ON d.vec_id <> q.q WHERE list_cosine_similarity(CAST(q.e AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])) > {least}"


def similar_vectors(spark, sf_dir, least):
    """Vectors with a cosine over ``least`` to a query vector (ids divisible by 50): the query set, in blocks, against all.

    The queries are written once; every task goes over them in blocks of ``QUERY_BLOCK``, a matrix product for each
    block and batch of vectors, so there is no shuffle, and neither plan nor memory grows with the table. Null vectors,
    and vectors of another length than a query's, match nothing.
    """
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("e")).where("vec_id is not null and e is not null")
    path = scratch_path(spark, "query-vectors")
    e.where(F.col("vec_id") % 50 == 0).write.parquet(path)

    def near(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        def normed(batch):
            """(ids, unit vectors) for each length of vector; a vector of zeros stays so."""
            ids, e, sizes = batch.column(0).to_numpy(), batch.column(1), batch.column(1).value_lengths().to_numpy()
            for size in np.unique(sizes[sizes > 0]).tolist():
                some = np.flatnonzero(sizes == size)
                v = np.asarray(e.take(pa.array(some)).flatten(), float).reshape(-1, size)
                yield size, ids[some], v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)

        where, folder = fs.FileSystem.from_uri(path)
        files = sorted(i.path for i in where.get_file_info(fs.FileSelector(folder)) if i.path.endswith(".parquet"))
        for batch in batches:
            mine = list(normed(batch))
            for file in files:
                for block in pq.ParquetFile(where.open_input_file(file)).iter_batches(QUERY_BLOCK):
                    for size, q_ids, q in normed(block):
                        for own, ids, v in mine:
                            if own == size:
                                cos = v @ q.T
                                i, j = np.nonzero((cos > least) & (ids[:, None] != q_ids))
                                yield pa.record_batch([pa.array(q_ids[j]), pa.array(ids[i]), pa.array(cos[i, j])], ["query_id", "vec_id", "cos"])

    pairs = e.mapInArrow(near, "query_id long, vec_id long, cos double")
    return pairs.select("query_id", "vec_id", F.round("cos", 6).alias("cos"))


@query(_COSINE.format(least=0.9))
def embeddings_cosine(spark, sf_dir):
    """Pairs over 0.9; the given vectors are far apart, so ``embeddings_cosine_wide`` has the pairs to compare."""
    return similar_vectors(spark, sf_dir, 0.9)


@query(_COSINE.format(least=0.3))
def embeddings_cosine_wide(spark, sf_dir):
    return similar_vectors(spark, sf_dir, 0.3)


@query(f"{_BACK} , r AS (SELECT message_id, sum(CASE WHEN last_back > ts - 604800000 THEN 1 ELSE 0 END) OVER w AS r, count(*) OVER w AS n FROM answered WINDOW w AS (PARTITION BY sender ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT:: message_id, CAST(r AS BIGINT) AS r, n FROM r")
def response_counts(spark, sf_dir):
    return with_responses(ev.messages(spark, sf_dir)).select("message_id", "r", "n")
