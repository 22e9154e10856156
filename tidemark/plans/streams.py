"""Streaming editions as queries: they take up the events as a stream, run until it is used up and return what they wrote.

Output and checkpoints are in the folder of ``spark.checkpoint.dir``, which all executors see.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.durations import days
from ..functions.text import has_email
from ..sources import events as ev
from ..sources.files import scratch_path
from ..streaming.replay import BatchSpam, window_top_words
from .detectors import _COUNTED, _IP
from .registry import query
from .words import _WORDS


def _raw_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as a stream; as a pattern its path may be one file or a folder of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")


def _run(stream: DataFrame, path: str, write, mode: str) -> None:
    stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(write).start().awaitTermination()


def _social(rows: DataFrame) -> DataFrame:
    """Messages and friendships under one another, from shaped events."""
    kind = F.when(F.col("event_type") == "signup", "friendship").when(F.col("event_type").isin(*ev.MESSAGE_TYPES), "message")
    out = rows.select(kind.alias("kind"), "ts", F.col("event_id").alias("id"), F.col("user_id").alias("user_a"), F.col("k").alias("user_b"), (F.col("user_id") % 15).cast("int").alias("ip"), has_email(ev.content()).alias("mail"))
    return out.where("kind is not null")


def _judged(spark, stream, path, flag, **options):
    target = BatchSpam(spark, f"{path}/state", lambda df, i: df.where(flag).select("message_id").write.mode("overwrite").parquet(f"{path}/out/batch={i}"), **options)
    _run(stream, path, target, "append")
    return spark.read.schema("message_id long, batch int").parquet(f"{path}/out").select("message_id")


@query(f"{_COUNTED} SELECT:: message_id FROM simple")
def stream_simple(spark, sf_dir):
    """The exact micro-batch detector over the whole stream."""
    return _judged(spark, _social(ev.shape(_raw_stream(spark, sf_dir))), scratch_path(spark, "stream-simple"), "is_spam")


def _by_time(spark: SparkSession, rows: DataFrame, path: str, parts: list, ts: str = "ts") -> DataFrame:
    """A stream of a table's rows in order of time: one file set after another for the parts (bounds), one a batch."""
    for a, b in zip(parts, parts[1:]):
        rows.where((F.col(ts) >= a) & (F.col(ts) < b)).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _slices(rows: DataFrame, ts: str, width: int, start: int) -> list:
    """Bounds of slices of one width, from ``start``, that hold all rows."""
    last = rows.agg(F.max(ts)).first()[0]
    return [start] if last is None else list(range(start, last + width + 1, width))


@query(f"{_COUNTED}, {_IP} SELECT:: s.message_id FROM simple s JOIN by_ip i USING (message_id) WHERE i.email / (i.email + i.noemail) > 0.2")
def stream_ip(spark, sf_dir):
    """The address detector in exact micro-batches of ten days: what a full replay finds."""
    path = scratch_path(spark, "stream-ip")
    rows = _social(ev.raw_events(spark, sf_dir))
    stream = _by_time(spark, rows, f"{path}/in", _slices(rows, "ts", days(10), ev.FIRST_PROBE))
    return _judged(spark, stream, path, "is_address_spam", by_address=True, compact_every=2)


@query("""cut AS (SELECT m.*, CAST(floor((m.ts - 1704067200000) / 864000000) AS BIGINT) AS batch, f.since FROM messages m LEFT JOIN friends f ON f.lo = least(m.sender, m.recipient) AND f.hi = greatest(m.sender, m.recipient)),
stale AS (SELECT *, since IS NOT NULL AND floor((since - 1704067200000) / 864000000) < batch AS knew, sum(CASE WHEN content LIKE '%@%' THEN 1 ELSE 0 END) OVER w AS e, count(*) OVER w AS n FROM cut WINDOW w AS (PARTITION BY sender_ip ORDER BY ts, message_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sums AS (SELECT sender, batch, sum(CASE WHEN knew THEN 1 ELSE 0 END) AS f, sum(CASE WHEN knew THEN 0 ELSE 1 END) AS nf FROM stale GROUP BY ALL),
past AS (SELECT sender, batch, coalesce(sum(f) OVER w, 0) AS f, coalesce(sum(nf) OVER w, 0) AS nf FROM sums WINDOW w AS (PARTITION BY sender ORDER BY batch RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT:: s.message_id FROM stale s JOIN past p USING (sender, batch) WHERE p.nf > 2 * p.f AND p.f + p.nf > 5 AND n > 0 AND e / n > 0.2""")
def stream_ip_lagged(spark, sf_dir):
    """The address detector with state that is read before a batch of ten days updates it, the address' by message."""
    path = scratch_path(spark, "stream-ip-lagged")
    rows = _social(ev.raw_events(spark, sf_dir))
    stream = _by_time(spark, rows, f"{path}/in", _slices(rows, "ts", days(10), ev.FIRST_PROBE))
    return _judged(spark, stream, path, "is_address_spam", by_address=True, lagged=True, compact_every=2)


@query(f"{_WORDS}, w AS (SELECT (ts // 15 - unnest([0, 1])) * 15 AS start, word FROM words), c AS (SELECT start, word, count(*) AS cnt FROM w GROUP BY ALL) SELECT:: start, word, cnt FROM c QUALIFY row_number() OVER (PARTITION BY start ORDER BY cnt DESC, word) <= 20")
def stream_word_window(spark, sf_dir):
    """The 20 commonest words of each window of 30 seconds every 15 seconds, over the documents as a stream.

    Documents come one a second in order of their ids, null texts have no words. A last row, far ahead, moves the
    watermark past every window.
    """
    path = scratch_path(spark, "stream-words")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null").select(F.timestamp_seconds("doc_id").alias("ts_time"), "text", F.col("doc_id").alias("ts"))
    last = docs.agg(F.max("ts")).first()[0]
    if last is None:
        return spark.createDataFrame([], "start long, word string, cnt long")
    first = docs.agg(F.min("ts")).first()[0]
    step = -(-(last - first + 1) // 4)
    end = spark.range(1).select(F.timestamp_seconds(F.lit(last + 1_000_000)).alias("ts_time"), F.lit("").alias("text"), F.lit(last + 1_000_000).cast("long").alias("ts"))
    parts = [docs.where((F.col("ts") >= first + i * step) & (F.col("ts") < first + (i + 1) * step)) for i in range(4)]
    for part in [*parts, end]:  # the stream goes on where it was each time that files have come
        part.write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(docs.schema).parquet(f"{path}/in").select("ts_time", "text")
        writer = window_top_words(stream, lambda df, i: df.select(F.unix_seconds("start").alias("start"), "word", "cnt").write.mode("overwrite").parquet(f"{path}/out/batch={i}"), f"{path}/state", 20, "30 seconds", "15 seconds", "1 second")
        writer.trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint").start().awaitTermination()
    return spark.read.schema("start long, word string, cnt long, batch int").parquet(f"{path}/out").drop("batch")


@query("SELECT:: CAST(ts // 86400000 AS BIGINT) AS day, event_type, count(*) AS cnt FROM raw_events GROUP BY ALL")
def stream_daily_counts(spark, sf_dir):
    """Counts of tumbling one-day windows, complete at the end of the stream."""
    path = scratch_path(spark, "stream-days")
    counts = _raw_stream(spark, sf_dir).groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("cnt"))
    out = counts.select(F.floor(F.unix_millis("w.start") / 86_400_000).alias("day"), "event_type", "cnt")
    _run(out, path, lambda df, i: df.write.mode("overwrite").parquet(f"{path}/out"), "complete")
    return spark.read.schema("day long, event_type string, cnt long").parquet(f"{path}/out")
