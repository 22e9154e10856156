import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark import plans
from tidemark.plans import detectors
from tidemark.sources import events as ev
from tidemark.streaming import replay

SF = "/root/testdata/sf0.001"


def by_day(spark, frame, path, days=3):
    """Files in order of time, `days` days each."""
    bounds = [ev.FIRST_PROBE + d * 86_400_000 for d in range(0, 33, days)]
    for a, b in zip(bounds, bounds[1:]):
        part = frame.where((F.col("ts") >= a) & (F.col("ts") < b)).coalesce(1)
        part.write.mode("append").parquet(str(path))
    return str(path)


def run(frame, start):
    start(frame.writeStream.trigger(availableNow=True).option("checkpointLocation", f"/tmp/tidemark-test-{uuid.uuid4().hex}")).awaitTermination(120)


def test_exact_batches_equal_the_full_replay(spark, tmp_path):
    m = ev.messages(spark, SF).select(F.lit("message").alias("kind"), "ts", F.col("message_id").alias("id"), F.col("sender").alias("user_a"), F.col("recipient").alias("user_b"))
    f = ev.friendships(spark, SF).select(F.lit("friendship").alias("kind"), "ts", F.lit(0).cast("long").alias("id"), "user_a", "user_b")
    path = by_day(spark, m.unionByName(f), tmp_path / "in")
    found = []
    target = replay.ExactSimpleSpam(spark, str(tmp_path / "state"), lambda df, _: found.extend(r.message_id for r in df.where("is_spam").collect()))
    stream = spark.readStream.schema("kind string, ts long, id long, user_a long, user_b long").option("maxFilesPerTrigger", 1).parquet(path)
    run(stream, lambda w: w.foreachBatch(target).start())
    assert sorted(found) == sorted(r.message_id for r in plans.QUERIES["simple_spam_messages"](spark, SF).collect())


def test_state_is_kept_as_deltas_and_collected(spark, tmp_path):
    """Many batches: bases take up deltas, what no batch needs any more is gone, and a batch that runs again agrees."""
    rng = random.Random(5)
    kinds = "kind string, ts long, id long, user_a long, user_b long, ip int, mail boolean"
    rows = [("friendship" if rng.random() < 0.2 else "message", 10 * i + rng.randrange(10), i, rng.randrange(4), rng.randrange(4), rng.randrange(2), rng.random() < 0.3) for i in range(150)]
    cuts = [rows[i : i + 10] for i in range(0, 150, 10)]
    found = {}

    def sink(df, i):
        for r in df.collect():
            found[r.message_id] = (r.is_friend, r.f, r.nf, r.email, r.noemail, r.is_address_spam)

    target = replay.BatchSpam(spark, str(tmp_path / "state"), sink, by_address=True, compact_every=3)
    for i, cut in enumerate(cuts):
        target(spark.createDataFrame(cut, kinds), i)
        if i in (5, 8):
            before = dict(found)
            target(spark.createDataFrame(cut, kinds), i)
            assert found == before
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["base-11", "base-14", "delta-12", "delta-13", "delta-14"]
    messages = [r for r in rows if r[0] == "message"]
    for _, t, i, a, b, ip, mail in messages:
        friend = lambda t, a, b: any(k == "friendship" and u <= t and {x, y} == {a, b} for k, u, _, x, y, *_ in rows)
        mine = [friend(u, x, y) for _, u, _, x, y, *_ in messages if x == a and u <= t]
        here = [m for _, u, *_, p, m in messages if p == ip and u <= t]
        f, nf, e = sum(mine), len(mine) - sum(mine), sum(here)
        assert found[i] == (friend(t, a, b), f, nf, e, len(here) - e, nf > 2 * f and f + nf > 5 and e / len(here) > 0.2)


def test_exact_batches_refuse_late_events(spark, tmp_path):
    target = replay.ExactSimpleSpam(spark, str(tmp_path / "state"), lambda df, _: df.collect())
    event = lambda t: spark.createDataFrame([("message", t, 1, 1, 2)], "kind string, ts long, id long, user_a long, user_b long")
    target(event(10), 0)
    target(event(11), 1)
    with pytest.raises(Exception, match="late write"):
        target(event(11), 2)


def test_lagged_stream_equals_lagged_batches(spark, tmp_path):
    m = detectors.flagged(spark, SF).select("ts", "message_id", "sender", "is_friend")
    path = by_day(spark, m, tmp_path / "in", 5)
    stream = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(path)
    name = "lagged_" + uuid.uuid4().hex
    run(replay.lagged_counts(stream), lambda w: w.format("memory").queryName(name).start())
    got = {r.message_id: (r.f, r.nf) for r in spark.table(name).collect()}
    rows = m.withColumn("b", F.floor((F.col("ts") - ev.FIRST_PROBE) / (5 * 86_400_000))).collect()
    for r in rows:
        past = [x.is_friend for x in rows if x.sender == r.sender and x.b < r.b]
        assert got[r.message_id] == (sum(past), len(past) - sum(past))


def write_times(spark, tmp_path, rows, schema):
    for i in range(0, len(rows), 25):
        spark.createDataFrame(rows[i : i + 25], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_running_counts_in_order_of_time(spark, tmp_path):
    rng, start = random.Random(1), dt.datetime(2024, 1, 1)
    rows = [(rng.choice("ab"), start + dt.timedelta(seconds=i // 2 * 4 + rng.randrange(8)), i) for i in range(100)]
    rows += [("z", start + dt.timedelta(days=1), 1000), ("z", start + dt.timedelta(days=2), 1001)]
    stream = write_times(spark, tmp_path, rows, "user string, ts_time timestamp, id long")
    name = "counts_" + uuid.uuid4().hex
    run(replay.ordered_running_count(stream, "user", "20 seconds"), lambda w: w.format("memory").queryName(name).start())
    got = {r.id: r.cnt for r in spark.table(name).collect() if r.user != "z"}
    assert got == {i: sum(u == v and s <= t for v, s, _ in rows) for u, t, i in rows if u != "z"}


def test_word_windows(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(seconds=i), f"one w{i % 3}") for i in range(60)] + [(start + dt.timedelta(days=1), "end")]
    stream = write_times(spark, tmp_path, rows, "ts_time timestamp, text string")
    name = "words_" + uuid.uuid4().hex
    run(replay.word_windows(stream), lambda w: w.format("memory").queryName(name).start())
    got = {(r.start, r.word): r.cnt for r in spark.table(name).collect() if r.word != "end"}
    for (begin, word), n in got.items():
        assert n == sum(word in t.split() and begin <= s < begin + dt.timedelta(seconds=30) for s, t in rows)
    assert sum(n for (_, w), n in got.items() if w == "one") == 3 * 60


def test_top_words_of_windows_in_batches(spark, tmp_path):
    """Windows over several batches, late texts, empty batches and odd texts; a batch that runs again agrees."""
    rng, start = random.Random(4), dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(seconds=i + rng.randrange(-3, 4)), rng.choice([None, "", "  ", "A b  b ", "\u00c9 c", "d " * rng.randrange(1, 6)])) for i in range(90)]
    batches = [rows[:30], [], rows[30:31], rows[31:60], [(start + dt.timedelta(seconds=5), "late")], [*rows[60:], (None, "x")], [(start + dt.timedelta(days=1), "end")]]
    found = {}
    target = replay.WindowTopWords(spark, str(tmp_path / "state"), lambda df, i: found.__setitem__(i, df.collect()), 2, "25 seconds", "10 seconds", "8 seconds")
    for i, batch in enumerate(batches):
        target(spark.createDataFrame(batch, "ts_time timestamp, text string"), i)
        if i == 3:
            before = sorted(found[3])
            target(spark.createDataFrame(batch, "ts_time timestamp, text string"), i)
            assert sorted(found[3]) == before
    words = [(t, w) for t, x in rows if x is not None and (x == "" or x.strip(" ")) for w in x.lower().rstrip(" ").split(" ")]
    want = set()
    for s in range(-30, 110, 10):
        begin = start + dt.timedelta(seconds=s)
        end = begin + dt.timedelta(seconds=25)
        counts = {}
        for t, w in words:
            if begin <= t < end:
                counts[w] = counts.get(w, 0) + 1
        want |= {(begin, end, w, n) for w, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:2]}
    got = [tuple(r) for part in found.values() for r in part if r.start.day == 1 or r.start.year < 2024]
    assert len(got) == len(set(got)) and set(got) == want
    assert not any(r[2] == "late" for r in got) and sorted(p.name for p in (tmp_path / "state").iterdir()) == ["latest-5", "latest-6", "open-5", "open-6"]
    assert sum(r.cnt for r in spark.read.parquet(str(tmp_path / "state/open-5")).groupBy().agg(F.count("*").alias("cnt")).collect()) < 60
