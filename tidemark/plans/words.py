"""Word counts over document texts and trailing windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import split_words
from ..operators import state
from ..sources import events as ev
from .registry import query

KEYWORD, TOP, WINDOW_MS = "the", 20, 30_000

_WORDS = """words AS (SELECT doc_id AS ts, unnest(CASE WHEN text <> '' AND rtrim(text, ' ') = '' THEN [] ELSE string_split(rtrim(lower(text), ' '), ' ') END) AS word FROM documents)"""


def words(spark, sf_dir):
    """ts, word: documents in order of id stand for messages, one second apart."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").alias("ts"), F.explode(split_words(F.col("text"))).alias("word"))


@query(f"{_WORDS} SELECT:: word, count(*) AS cnt FROM words GROUP BY word")
def word_count(spark, sf_dir):
    return words(spark, sf_dir).groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))


@query(f"{_WORDS}, b AS (SELECT min(doc_id) AS lo, max(doc_id) AS hi FROM documents), p AS (SELECT DISTINCT CAST(lo + (hi - lo) * i // 9 AS BIGINT) AS probe_ts FROM b, range(10) t(i) WHERE hi IS NOT NULL) SELECT:: p.probe_ts, count(w.word) AS cnt FROM p LEFT JOIN words w ON w.ts <= p.probe_ts AND w.word = 'the' GROUP BY p.probe_ts")
def keyword_count_asof(spark, sf_dir):
    """At ten times (fewer where ids are fewer) spread evenly from the first id to the last, which sees every document."""
    b = spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    probes = [] if b.hi is None else sorted({b.lo + (b.hi - b.lo) * i // 9 for i in range(10)})
    one = words(spark, sf_dir).where(F.col("word") == KEYWORD)
    return state.running_at_probes(one, probes, {"cnt": F.lit(1)})


@query(f"{_WORDS}, c AS (SELECT CAST(ceil(ts / 30) AS BIGINT) * 30000 AS probe_ts, word, count(*) AS cnt FROM words GROUP BY ALL) SELECT:: probe_ts, word, cnt FROM c QUALIFY row_number() OVER (PARTITION BY probe_ts ORDER BY cnt DESC, word) <= 20")
def word_topk_sliding(spark, sf_dir):
    """The 20 commonest words of the trailing 30 seconds at every 30 seconds, so that each document is in one window."""
    rows = words(spark, sf_dir).withColumn("ts", F.col("ts") * 1000)
    probe = F.ceil(F.col("ts") / WINDOW_MS) * WINDOW_MS
    counts = rows.groupBy(probe.alias("probe_ts"), "word").agg(F.count(F.lit(1)).alias("cnt"))
    return state.top_k(counts, TOP, "cnt", "word", ("probe_ts",))


@query(f"{_WORDS} SELECT:: CAST(floor(ts / 30) AS BIGINT) AS slot, word, count(*) AS cnt FROM words GROUP BY ALL")
def word_tumbling_counts(spark, sf_dir):
    return words(spark, sf_dir).groupBy(F.floor(F.col("ts") / 30).alias("slot"), "word").agg(F.count(F.lit(1)).alias("cnt"))


@query("w AS (SELECT message_id, ts, unnest(string_split(rtrim(content, ' '), ' ')) AS word FROM messages) SELECT:: message_id, word, count(*) OVER (PARTITION BY word ORDER BY ts RANGE BETWEEN 29999 PRECEDING AND CURRENT ROW) AS cnt FROM w")
def word_sliding_per_message(spark, sf_dir):
    """Counts of each word over the trailing 30 seconds at each message; windows are dealt by time, so no word is hot."""
    rows = ev.messages(spark, sf_dir).select("message_id", "ts", F.explode(split_words(F.col("content"))).alias("word"))
    return state.sliding(rows, ["word"], {"cnt": (F.count(F.lit(1)), WINDOW_MS)}).select("message_id", "word", "cnt")
