"""Statistics of logs: histograms, power-law fits, event rates, skew and run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def activity(rows: DataFrame, user: str) -> DataFrame:
    return rows.groupBy(F.col(user).alias("user")).agg(F.count(F.lit(1)).alias("n"))


def histogram(counts: DataFrame, value: str = "n") -> DataFrame:
    """How many users have each count: (n, users)."""
    return counts.groupBy(F.col(value).alias("n")).agg(F.count(F.lit(1)).alias("users"))


def sampled_ranks(limit: int) -> list[int]:
    """Ranks 1, 2, ... whose step grows to a tenth of the rank."""
    out, at = [], 1
    while at <= limit:
        out.append(at)
        at += max(1, at // 10)
    return out


def powerlaw_slope(counts: DataFrame, users: int) -> DataFrame:
    """Zipf and power-law exponents by least squares on log rank and log probability at sampled ranks: one row.

    Ranks come from the histogram (as many rows as distinct counts), not from sorting users: the user at a rank is
    in the count whose cumulated users reach it.
    """
    spark = counts.sparkSession
    shape = histogram(counts)
    above = F.sum("users").over(W.orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, 0))  # distinct counts only
    total = F.sum(F.col("n") * F.col("users")).over(W.partitionBy())
    ranked = shape.select("n", above.alias("upto"), (above - F.col("users")).alias("past"), total.alias("total"))
    ranks = F.broadcast(spark.createDataFrame([(r,) for r in sampled_ranks(users)], "rank long"))
    points = ranked.join(ranks, (F.col("rank") > F.col("past")) & (F.col("rank") <= F.col("upto")))
    slope = F.regr_slope(F.log(F.col("n") / F.col("total")), F.log(F.col("rank").cast("double")))
    return points.agg((-slope).alias("zipf"), (1 + 1 / (-slope)).alias("alpha"))


def powerlaw_mle(counts: DataFrame, least: float = 5.0) -> DataFrame:
    """The maximum-likelihood exponent 1 + n / sum(ln(x / least)) over counts of at least ``least``: one row."""
    fit = counts.where(F.col("n") >= least).agg((1 + F.count(F.lit(1)) / F.sum(F.log(F.col("n") / least))).alias("alpha"))
    return fit.select("alpha", (1 / (F.col("alpha") - 1)).alias("zipf"))


def event_rate(events: DataFrame, part: Column, first_n: int = 10_000, ts: str = "ts", tiebreak: str = "event_id") -> DataFrame:
    """start_ts and mean gap: per part the span of its first events, a whole-number mean over parts, by first_n."""
    rank = F.row_number().over(W.partitionBy("part").orderBy(ts, tiebreak))
    spans = events.withColumn("part", part).withColumn("rank", rank).where(F.col("rank") <= first_n).groupBy("part").agg(F.min(ts).alias("first"), F.max(ts).alias("last"))
    return spans.agg(F.min("first").alias("start_ts"), (F.expr("sum(last - first) div count(1)") / F.lit(float(first_n))).alias("interval_ms"))


def skew(values: DataFrame, value: str) -> DataFrame:
    """Largest times number over sum, with quartiles, mean and maximum: one row."""
    v = F.col(value)
    return values.agg((F.max(v) * F.count(v) / F.sum(v)).alias("skew"), F.percentile(v, 0.25).alias("q1"), F.percentile(v, 0.5).alias("median"), F.percentile(v, 0.75).alias("q3"), F.avg(v).alias("mean"), F.max(v).alias("largest"))


def separate_ties(events: DataFrame, bucket_ms: int = 86_400_000, ts: str = "ts", tiebreak: str = "event_id") -> DataFrame:
    """Events with times shifted by 1 ms more at every event whose time repeats the one before it.

    Repeats are counted in two steps, within time buckets and over their totals; equal times share a bucket.
    """
    repeat = (F.row_number().over(W.partitionBy(ts).orderBy(tiebreak)) > 1).cast("long")
    marked = events.withColumn("__repeat", repeat).withColumn("__bucket", F.floor(F.col(ts) / bucket_ms))
    totals = marked.groupBy("__bucket").agg(F.sum("__repeat").alias("__total"))
    before = totals.select("__bucket", (F.sum("__total").over(W.orderBy("__bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("__total")).alias("__before"))
    within = F.sum("__repeat").over(W.partitionBy("__bucket").orderBy(ts, tiebreak).rowsBetween(W.unboundedPreceding, 0))
    shifted = marked.withColumn("__within", within).join(before, "__bucket")
    return shifted.withColumn(ts, F.col(ts) + F.col("__before") + F.col("__within")).drop("__repeat", "__bucket", "__within", "__before")


# What run logs are searched for.
TIMING = r"real\s+(\d+)m(\d+).(\d+)s"
RUN_NAME = r"(^[0-9a-f\-]+)-(\d+)-(\d+)-(\d+)-([a-zA-Z\.]+)-(true|false)-(\d+)-([\d\.]+).timing"
PERF = {
    "reader_thread_ms": r"reader thread time (\d+) ms",
    "phase_threads_ms": r"thread \d+ \(phase \d+\) finished with elapsed cpu time (\d+) ms",
    "io_boss_ms": r"boss thread pool time: (\d+) ms",
    "io_worker_ms": r"worker thread pool time: (\d+) ms",
    "kryo_send_ms": r"sent_kryo_ms=(\d+)",
    "kryo_recv_ms": r"recv_kryo_ms=(\d+)",
    "kryo_send_bytes": r"sent_bytes=(\d+)",
    "kryo_recv_bytes": r"recv_bytes=(\d+)",
}


def parse_timings(files: DataFrame) -> DataFrame:
    """Runs from timing files (name, text): the parts of the name and the elapsed milliseconds; others are left out."""
    part = lambda i: F.regexp_extract("name", RUN_NAME, i)
    time = lambda i: F.regexp_extract("text", TIMING, i).cast("long")
    fit = files.where(F.col("name").rlike(RUN_NAME) & F.col("text").rlike(TIMING) & ~F.col("text").contains("Exception"))
    return fit.select(part(1).alias("uuid"), part(5).alias("detector"), part(2).cast("int").alias("hosts"), part(3).cast("int").alias("partitions"), part(4).cast("int").alias("iteration"), part(8).cast("double").alias("alpha"), part(7).cast("int").alias("batchsize"), (time(1) * 60_000 + time(2) * 1000 + time(3)).alias("overall_ms"))


def summarise_perf(files: DataFrame, run: str = "run") -> DataFrame:
    """Per run the sums of all positive figures in its performance files (run, text), and the skew of bytes."""
    found = files.select(run, *[F.filter(F.transform(F.regexp_extract_all("text", F.lit(p), 1), lambda x: x.cast("long")), lambda x: x > 0).alias(n) for n, p in PERF.items()])
    total = lambda n: F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x)
    sums = found.select(run, *[total(n).alias(n) for n in PERF], *[F.array_max(n).alias(f"{n}_max") for n in ("kryo_send_bytes", "kryo_recv_bytes")], *[F.size(n).alias(f"{n}_n") for n in ("kryo_send_bytes", "kryo_recv_bytes")])
    out = sums.groupBy(run).agg(*[F.sum(n).alias(n) for n in PERF], *[F.max(f"kryo_{d}_bytes_max").alias(f"max_{d}") for d in ("send", "recv")], *[F.sum(f"kryo_{d}_bytes_n").alias(f"n_{d}") for d in ("send", "recv")])
    ratio = lambda d: F.coalesce(F.col(f"max_{d}") * F.col(f"n_{d}") / F.nullif(F.col(f"kryo_{d}_bytes"), F.lit(0)), F.lit(0.0))
    return out.select(run, *PERF, ratio("send").alias("kryo_send_skew"), ratio("recv").alias("kryo_recv_skew"))
