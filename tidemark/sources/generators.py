"""Synthetic events: uniform users, or Zipf users with spammers; everything follows from the seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.durations import at

START, SEED = at("2015-01-01"), 903485435
BURST, SPAMMER_SHARE, SPAM_MAIL, PLAIN_MAIL = 20, 0.02, 0.5, 0.1


def _unit(row: str, what: str, seed: int):
    """A number in [0, 1) that depends on the row, the purpose and the seed alone, not on partitions."""
    return F.pmod(F.xxhash64(row, F.lit(what), F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _with_time(rows: DataFrame, mean_gap_ms: int, start: int, seed: int, block: int = 10_000) -> DataFrame:
    """Times from random gaps: a running sum within blocks of ids, and a running sum of the blocks' totals."""
    gaps = rows.withColumn("gap", F.floor(_unit("id", "gap", seed) * 2 * mean_gap_ms).cast("long")).withColumn("block", F.floor(F.col("id") / block))
    totals = gaps.groupBy("block").agg(F.sum("gap").alias("total"))  # one row for `block` ids
    before = totals.select("block", (F.sum("total").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, 0)) - F.col("total")).alias("before"))
    within = F.sum("gap").over(W.partitionBy("block").orderBy("id").rowsBetween(W.unboundedPreceding, 0))
    return gaps.withColumn("within", within).join(before, "block").withColumn("ts", F.lit(start) + F.col("before") + F.col("within")).drop("gap", "block", "within", "before")


def uniform_events(spark: SparkSession, users: int, n: int, start: int = START, seed: int = SEED) -> DataFrame:
    """Half friendships, half messages between uniform users: ts, kind, id, user_a, user_b, ip, content."""
    rows = spark.range(n).withColumn("kind", F.when(_unit("id", "kind", seed) < 0.5, "friendship").otherwise("message"))
    for name in ("user_a", "user_b"):
        rows = rows.withColumn(name, F.floor(_unit("id", name, seed) * users).cast("long"))
    return _with_time(rows, 50_000, start, seed).select("ts", "kind", "id", "user_a", "user_b", F.lit(0).alias("ip"), F.lit("").alias("content"))


def tunable_events(spark: SparkSession, users: int, n: int, alpha: float = 2.0, start: int = START, seed: int = SEED) -> DataFrame:
    """Zipf users with probability of rank ** (-1 / (alpha - 1)); the last 2 % of ids send bursts to uniform users.

    Columns as ``uniform_events``. Ranks come from the inverse of the continuous power law, so no table of users is
    needed. One event in 40 of a spammer's is a burst of 20 messages; mail addresses are in half the spammers' and
    a tenth of the others' messages; a pair's friendship is kept once, at its first time. Addresses are the user id
    modulo a tenth of the users.
    """
    s, top = 1.0 / (alpha - 1.0), float(users)

    def rank(what):
        u = _unit("id", what, seed)
        value = F.exp(u * F.log(F.lit(top + 1))) if abs(s - 1) < 1e-9 else F.pow(1 + u * (F.pow(F.lit(top + 1), F.lit(1 - s)) - 1), F.lit(1 / (1 - s)))
        return F.least(F.floor(value).cast("long") - 1, F.lit(users - 1))

    spammers = max(1, int(users * SPAMMER_SHARE))
    rows = spark.range(n).withColumn("user_a", rank("user_a")).withColumn("spammer", F.col("user_a") >= users - spammers)
    rows = rows.withColumn("kind", F.when(_unit("id", "kind", seed) < F.when(F.col("spammer"), 0.0).otherwise(0.5), "friendship").otherwise("message"))
    rows = rows.withColumn("copies", F.when(F.col("spammer") & (_unit("id", "burst", seed) < 1 / 40), BURST).otherwise(1))
    rows = _with_time(rows, 50_000, start, seed).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    rows = rows.withColumn("id", F.col("id") * BURST + F.col("copy")).withColumn("ts", F.col("ts") + F.col("copy"))
    rows = rows.withColumn("user_b", F.when(F.col("spammer"), F.floor(_unit("id", "target", seed) * users).cast("long")).otherwise(rank("user_b")))
    mail = _unit("id", "mail", seed) < F.when(F.col("spammer"), SPAM_MAIL).otherwise(PLAIN_MAIL)
    rows = rows.withColumn("content", F.when(mail, F.concat(F.lit("word w"), F.col("user_a").cast("string"), F.lit("@email.com "))).otherwise("some words"))
    rows = rows.withColumn("ip", (F.col("user_a") % max(1, users // 10)).cast("int"))
    made = rows.select("ts", "kind", "id", "user_a", "user_b", "ip", "content")
    pair = [F.least("user_a", "user_b"), F.greatest("user_a", "user_b")]
    first = made.where("kind = 'friendship' and user_a != user_b").groupBy(*pair).agg(F.min(F.struct("ts", "kind", "id", "user_a", "user_b", "ip", "content")).alias("e")).select("e.*")
    return made.where("kind = 'message'").unionByName(first)
