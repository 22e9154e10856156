import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.functions import durations, text
from tidemark.operators import causal, stats
from tidemark.plans import QUERIES
from tidemark.sources import events, files, generate, generators

# Strings and whether they hold an e-mail address.
EMAILS = [("", False), ("foo@example.com", True), ("hi foo@example.com there", True), ("a.b+c@x.y.org", True), ("foo_bar@sub.example.co.uk!", True), ("say hi to w1@email.com ", True), ("not an @ address", False)]


def test_emails(spark):
    rows = spark.createDataFrame([(s, w) for s, w in EMAILS], "s string, w boolean")
    assert all(r.got == r.w for r in rows.select("w", text.has_email(F.col("s")).alias("got")).collect())


def test_words(spark):
    cases = {"": [""], "  ": [], "A b": ["a", "b"], " a  b  ": ["", "a", "", "b"], None: None}
    rows = spark.createDataFrame([(s,) for s in cases], "s string").select("s", text.split_words(F.col("s")).alias("w")).collect()
    assert {r.s: r.w for r in rows} == cases


def test_durations():
    assert (durations.seconds(1.5), durations.minutes(2), durations.days(30), durations.weeks(1)) == (1500, 120_000, 2_592_000_000, 604_800_000)
    assert durations.at("2015-01-01") == 1_420_070_400_000


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(1000).selectExpr("id as event_id", "id * 10 as ts", "id % 13 as k")


def test_files(spark, rows, tmp_path):
    files.write_events(rows, f"{tmp_path}/all")
    files.write_round_robin(rows, f"{tmp_path}/rr", 4)
    files.write_by_key(rows, f"{tmp_path}/keys", 3, "k")
    for name in ("all", "rr", "keys"):
        assert files.read_events(spark, f"{tmp_path}/{name}").select(*rows.columns).exceptAll(rows).count() == 0
        assert files.read_events(spark, f"{tmp_path}/{name}").count() == 1000
    assert len([*Path(f"{tmp_path}/rr").glob("part-*.parquet")]) == 4
    parts = files.read_events(spark, f"{tmp_path}/keys").groupBy("k").agg(F.countDistinct("part").alias("n"))
    assert all(r.n == 1 for r in parts.collect())
    assert [r.event_id for r in files.first_events(rows, 3).collect()] == [0, 1, 2]


def test_generators(spark):
    made = generators.uniform_events(spark, 50, 2000)
    assert made.count() == 2000 and made.exceptAll(generators.uniform_events(spark, 50, 2000)).count() == 0
    assert made.where("user_a < 0 or user_a >= 50").count() == 0
    zipf = generators.tunable_events(spark, 200, 4000, 2.0)
    assert zipf.exceptAll(generators.tunable_events(spark, 200, 4000, 2.0)).count() == 0
    top = zipf.where("kind = 'message' and user_a < 196").groupBy("user_a").count().orderBy(F.desc("count")).first()
    assert top.user_a == 0
    pairs = zipf.where("kind = 'friendship'").groupBy(F.least("user_a", "user_b"), F.greatest("user_a", "user_b")).count()
    assert pairs.where("count > 1").count() == 0
    assert zipf.where("ip != user_a % 20").count() == 0


def test_generator_command(spark, tmp_path):
    generate.main(["tunable", "50", "300", f"{tmp_path}/t", "--splits", "2", "--by-key", "--alpha", "1.8"])
    generate.main(["uniform", "50", "300", f"{tmp_path}/u", "--splits", "3"])
    assert files.read_events(spark, f"{tmp_path}/u").count() == 300
    for extra in ([], ["--by-key"]):
        where = f"{tmp_path}/keep{len(extra)}"
        for k in ("0", "1", "2"):
            generate.main(["uniform", "50", "300", f"{where}-{k}", "--splits", "3", "--keep-only", k, *extra])
        assert sum(files.read_events(spark, f"{where}-{k}").count() for k in range(3)) == 300
        assert len({r.id for k in range(3) for r in files.read_events(spark, f"{where}-{k}").select("id").collect()}) == 300
    generate.main(["uniform", "50", "301", f"{tmp_path}/b", "--batches", "3"])
    ends = [files.read_events(spark, f"{tmp_path}/b-{i}").agg(F.count(F.lit(1)), F.min("ts"), F.max("ts")).first() for i in range(3)]
    assert [e[0] for e in ends] == [101, 101, 99] and ends[0][2] <= ends[1][1] and ends[1][2] <= ends[2][1]
    with pytest.raises(SystemExit):
        generate.main(["uniform", "5", "5", f"{tmp_path}/x", "--splits", "2", "--keep-only", "2"])
    assert {r.kind for r in files.read_events(spark, f"{tmp_path}/t").select("kind").distinct().collect()} == {"message", "friendship"}


def test_times_do_not_depend_on_the_session_zone(spark):
    day = events.raw_events(spark, "/root/testdata/sf0.001").agg(F.min("ts")).first()[0]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert events.raw_events(spark, "/root/testdata/sf0.001").agg(F.min("ts")).first()[0] == day >= events.FIRST_PROBE
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_powerlaw_fits(spark):
    counts = spark.createDataFrame([(i, 10_000 // (i + 1)) for i in range(2000)], "user long, n long")
    fit = stats.powerlaw_slope(counts, 2000).first()
    assert abs(fit.zipf - 1) < 0.02 and abs(fit.alpha - 2) < 0.02
    assert abs(stats.powerlaw_mle(counts).first().alpha - 2) < 0.1
    assert stats.sampled_ranks(25) == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 22, 24]


def test_event_rate(spark, rows):
    got = stats.event_rate(rows, F.col("event_id") % 2, 10).first()
    assert got.start_ts == 0 and got.interval_ms == 18.0


def test_separate_ties(spark):
    rows = spark.createDataFrame([(1, 5), (2, 5), (3, 5), (4, 6), (5, 100)], "event_id long, ts long")
    assert {r.event_id: r.ts for r in stats.separate_ties(rows, 10).collect()} == {1: 5, 2: 6, 3: 7, 4: 8, 5: 102}


def test_run_logs(spark):
    name = "ab12-4-8-2-SimpleSpam.Stats-true-10000-1.5.timing"
    timings = spark.createDataFrame([(name, "x\nreal\t1m2.345s\nuser"), ("other.timing", "real 0m1.000s"), (name.replace("ab12", "cd34"), "Exception\nreal 0m1.000s")], "name string, text string")
    (r,) = stats.parse_timings(timings).collect()
    assert (r.uuid, r.detector, r.hosts, r.partitions, r.iteration, r.alpha, r.batchsize, r.overall_ms) == ("ab12", "SimpleSpam.Stats", 4, 8, 2, 1.5, 10000, 62345)
    perf = spark.createDataFrame([("r", "reader thread time 5 ms\nsent_bytes=10\nsent_bytes=30\nsent_bytes=0"), ("r", "reader thread time 7 ms\nthread 1 (phase 2) finished with elapsed cpu time 9 ms\nsent_bytes=20"), ("s", "")], "run string, text string")
    got = {r.run: r for r in stats.summarise_perf(perf).collect()}
    assert (got["r"].reader_thread_ms, got["r"].phase_threads_ms, got["r"].kryo_send_bytes, got["r"].kryo_send_skew) == (12, 9, 60, 1.5)
    assert got["s"].kryo_send_skew == 0.0


def test_causal_edges_by_hand(spark):
    w = spark.createDataFrame([("a", 1), ("a", 3), ("a", 3), ("a", 9), ("b", 2)], "cell string, ts long")
    r = spark.createDataFrame([("a", 3), ("a", 5), ("b", 1), ("b", 4)], "cell string, ts long")
    assert sorted(tuple(e) for e in causal.causal_edges(w, r, ["cell"]).collect()) == [(1, 3), (2, 4), (3, 5)]


def longest(edges):
    from functools import cache

    back = {}
    for a, b in edges:
        back.setdefault(b, set()).add(a)

    @cache
    def depth(v):
        return max((depth(u) + 1 for u in back.get(v, ())), default=0)

    nodes = {v for e in edges for v in e}
    return max(map(depth, sorted(nodes))), len(nodes)


def test_critical_paths_equal_another_program(spark):
    rng = random.Random(1)
    edges = {(a, a + rng.randint(1, 30)) for a in (rng.randrange(300) for _ in range(250))}
    batched = causal.batch_edges(spark.createDataFrame(sorted(edges), "src_ts long, dst_ts long"), 0, 100)
    got = {r.batch: (r.length, r.vertices) for r in causal.critical_paths(batched).collect()}
    assert got == {b: longest([e for e in edges if e[1] // 100 == b]) for b in {e[1] // 100 for e in edges}}
    with pytest.raises(Exception):
        causal.batch_edges(spark.createDataFrame([(5, 5)], "src_ts long, dst_ts long"), 0, 100).collect()
    assert QUERIES["critical_path"](spark, "/root/testdata/sf0.001").count() > 0
