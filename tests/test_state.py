import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import state
from tidemark.plans import detectors


def ledger(spark, rows, schema="k long, ts long, v long"):
    return spark.createDataFrame(rows, schema)


def reads_of(spark, ts, key=0):
    return spark.createDataFrame([(key, t) for t in ts], "k long, ts long")


def test_counter_same_time(spark):
    out = state.asof_running(reads_of(spark, [100, 199, 200, 300]), ledger(spark, [(0, 200, 1), (0, 200, 6)]), ["k"], {"n": ("sum", "v")})
    assert {r.ts: r.n for r in out.collect()} == {100: None, 199: None, 200: 7, 300: 7}


def test_counter_long(spark):
    rows = [(0, i * 100, i % 5) for i in range(1, 101)]
    want = {50: None, 150: 1, 250: 3, 399: 6, 400: 10, 599: 10, 600: 11, 9100: 181, 9199: 181, 9200: 183}
    out = state.asof_running(reads_of(spark, want), ledger(spark, rows), ["k"], {"n": ("sum", "v")})
    assert {r.ts: r.n for r in out.collect()} == want
    totals = state.running_at_probes(ledger(spark, rows), [*want], {"n": F.col("v")})
    assert {r.probe_ts: r.n for r in totals.collect()} == {t: n or 0 for t, n in want.items()}


def test_past_reads(spark):
    out = state.asof_running(reads_of(spark, [49, 50, 140, 150]), ledger(spark, [(0, 50, 10), (0, 100, 1), (0, 150, 3)]), ["k"], {"n": ("sum", "v")})
    assert {r.ts: r.n for r in out.collect()} == {49: None, 50: 10, 140: 11, 150: 14}


def test_late_write_is_refused(spark):
    writes = ledger(spark, [(0, 155, 5)])
    assert state.check_no_late_writes(writes, 150).count() == 1
    with pytest.raises(Exception, match="late write"):
        state.check_no_late_writes(writes, 160).collect()


def test_map_fold(spark):
    rows = [("k1", 50, 0, "add", 7), ("k1", 100, 0, "times", 3), ("k2", 50, 0, "times", 3), ("k2", 100, 0, "add", 7), ("k3", 75, 0, "add", 12)]
    book = spark.createDataFrame(rows, "k string, ts long, seq long, op string, arg long")
    asked = spark.createDataFrame([("k2", 200), ("k1", 100), ("k3", 60), ("k3", 100)], "k string, read_ts long")
    out = state.asof_fold(asked, book, ["k"], {"add": lambda z, a: z + a, "times": lambda z, a: z * a}, 5, "bigint")
    assert {(r.k, r.read_ts): r.value for r in out.collect()} == {("k2", 200): 22, ("k1", 100): 36, ("k3", 60): None, ("k3", 100): 17}


@pytest.mark.parametrize(
    ("more", "k", "want"),
    [
        ([], 3, [(2, 15), (3, 12), (5, 9)]),
        ([(6, 10, 1), (6, 12, 4)], 4, [(2, 15), (3, 12), (6, 12), (5, 9)]),
        ([(6, 14, 1), (6, 4, 5)], 4, [(2, 15), (3, 12), (5, 9), (1, 5)]),
    ],
)
def test_top_k_of_a_snapshot(spark, more, k, want):
    rows = [(1, 5, 4), (1, 10, 8), (2, 15, 2), (2, 2, 7), (3, 12, 3), (4, 17, 7), (5, 9, 3), *more]
    sets = spark.createDataFrame(rows, "key long, value long, ts long").where("ts <= 5")
    snapshot = sets.groupBy("key").agg(F.max_by("value", "ts").alias("value"))
    assert [tuple(r) for r in state.top_k(snapshot, k, "value", "key").collect()] == want
    assert state.top_k(snapshot, k, "value", "key", most=2).count() == 2


def brute(rows, read, strict=False, width=None):
    key, t = read
    return [v for k, u, v in rows if k == key and (u < t if strict else u <= t) and (width is None or u > t - width)]


@pytest.fixture(scope="module")
def random_rows():
    rng = random.Random(2)
    return [(rng.choice([0, 0, 0, 1, 2, None]), rng.randrange(200), rng.randrange(10)) for _ in range(400)]


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("split", [None, 17, 1000])
def test_running_equals_brute_force(spark, random_rows, strict, split):
    aggs = {"s": ("sum", F.col("v")), "n": ("count", F.lit(1)), "lo": ("min", F.col("v")), "hi": ("max", F.col("v"))}
    out = state.running(ledger(spark, random_rows).repartition(3), ["k"], aggs, strict=strict, split_ms=split).collect()
    assert len(out) == len(random_rows)
    for r in out:
        seen = brute(random_rows, (r.k, r.ts), strict)
        assert (r.s, r.n, r.lo, r.hi) == (sum(seen), len(seen), min(seen, default=None), max(seen, default=None))


@pytest.mark.parametrize("split", [False, True])
def test_sliding_equals_brute_force(spark, random_rows, split):
    out = state.sliding(ledger(spark, random_rows), ["k"], {"s": (F.sum("v"), 13), "n": (F.count(F.lit(1)), 13), "near": (F.count(F.lit(1)), 5)}, split=split).collect()
    assert len(out) == len(random_rows)
    for r in out:
        seen = brute(random_rows, (r.k, r.ts), width=13)
        assert (r.s, r.n, r.near) == (sum(seen), len(seen), len(brute(random_rows, (r.k, r.ts), width=5)))


@pytest.mark.parametrize("split", [True, False])
@pytest.mark.parametrize("strict", [True, False])
def test_sliding_counts_of_values_and_of_distinct_ones(spark, split, strict):
    """Ties, gaps of exactly a width, null values, null keys and null times."""
    rng = random.Random(8)
    rows = [(rng.choice([0, 1, None]), rng.choice([None, *range(0, 120, 4), *range(7)]), rng.choice([None, 1, 2, 3]), i) for i in range(300)]
    aggs = {"n": ("count", F.lit(1), 13), "some": ("count", F.col("v"), 8), "who": ("distinct", F.col("v"), 8), "near": ("distinct", F.col("v"), 4), "least": (F.min("v"), 13)}
    out = state.sliding(ledger(spark, rows, "k long, ts long, v long, id long"), ["k"], aggs, split=split, strict=strict)
    assert out.columns == ["k", "ts", "v", "id", *aggs]
    found = out.collect()
    assert sorted(r.id for r in found) == list(range(300))
    for r in found:
        if r.ts is None:
            if strict:
                continue
            seen = lambda w: [v for k, t, v, _ in rows if k == r.k and t is None]
        else:
            seen = lambda w: [v for k, t, v, _ in rows if k == r.k and t is not None and r.ts - w < t <= r.ts - strict]
        distinct = lambda w: len({v for v in seen(w)} - {None})
        assert (r.n, r.some, r.who, r.near) == (len(seen(13)), sum(v is not None for v in seen(8)), distinct(8), distinct(4))
        assert r.least == min((v for v in seen(13) if v is not None), default=None)


def test_sliding_counts_do_not_grow_with_the_window(spark):
    """One key whose windows hold up to all of 150,000 rows: whoever goes over them at each row takes hours."""
    rows = spark.range(150_000).select(F.lit(1).alias("k"), F.col("id").alias("ts"), (F.col("id") % 50).alias("v"))
    out = state.sliding(rows, ["k"], {"n": ("count", F.lit(1), 150_000), "who": ("distinct", F.col("v"), 100_000)})
    assert out.agg(F.sum("n"), F.sum(F.col("who"))).first()[:] == (150_000 * 150_001 // 2, 50 * 150_000 - sum(range(50)))


def test_asof_equals_brute_force(spark, random_rows):
    asked = [(k, t) for k in (0, 1, 5) for t in range(0, 200, 7)]
    reads = spark.createDataFrame([(*a, i) for i, a in enumerate(asked)], "k long, ts long, v long")
    for strict, within, split in ((False, None, None), (True, None, 20), (False, 10, 50)):
        rows = state.asof(reads, ledger(spark, random_rows).withColumnRenamed("v", "w"), ["k"], ["w"], strict=strict, within_ms=within, split_ms=split).collect()
        assert len(rows) == len(asked)
        for r in rows:
            seen = [(t, v) for k, t, v in random_rows if k == r.k and (t < r.ts if strict else t <= r.ts)]
            best = max(seen, default=(None, None))
            if within and best[0] is not None and best[0] <= r.ts - within:
                best = (None, None)
            assert (r.found_ts, r.w) == best


@pytest.mark.parametrize(("strict", "width", "split"), [(False, None, None), (True, None, 30), (False, 13, None), (True, 13, None)])
def test_asof_running_equals_brute_force(spark, random_rows, strict, width, split):
    reads = spark.createDataFrame([(k, t) for k in (0, 1, 5) for t in range(0, 200, 7)], "k long, ts long")
    kinds = {k: (k, "v") for k in ("sum", "count", "min", "max", "avg")}
    for r in state.asof_running(reads, ledger(spark, random_rows), ["k"], kinds, strict=strict, width_ms=width, split_ms=split).collect():
        seen = brute(random_rows, (r.k, r.ts), strict, width)
        want = (sum(seen), len(seen), min(seen), max(seen), sum(seen) / len(seen)) if seen else (None,) * 5
        assert (r["sum"], r["count"], r["min"], r["max"], r["avg"]) == want


def test_first_rows_are_marked(spark):
    rows = spark.createDataFrame([("a", 2, 1), ("a", 1, 2), ("a", 1, 3), ("b", 5, 4)], "k string, ts long, message_id long")
    assert {r.message_id: r.new for r in state.mark_first(rows, ["k"], "new").collect()} == {1: 0, 2: 1, 3: 0, 4: 1}


def test_ties_by_arrival(spark):
    rows = spark.createDataFrame([(0, 5, i) for i in range(4)], "k long, ts long, seq long")
    w = state.frame(["k"], ties="rows", tiebreak=("seq",))
    assert sorted(r.n for r in rows.withColumn("n", F.count(F.lit(1)).over(w)).collect()) == [1, 2, 3, 4]
    split = state.running(rows, ["k"], {"n": ("count", F.lit(1))}, split_ms=2, ties="rows", tiebreak=("seq",))
    assert {r.seq: r.n for r in split.collect()} == {0: 1, 1: 2, 2: 3, 3: 4}
    with pytest.raises(ValueError):
        state.frame(["k"], width_ms=5, ties="rows")


def test_lagged_batches_see_earlier_ones_only(spark):
    rows = spark.createDataFrame([("a", 0, 1), ("a", 0, 2), ("a", 2, 4), ("b", 1, 8)], "k string, batch long, v long")
    out = state.lagged(rows, ["k"], "batch", {"s": F.col("v")})
    assert sorted((r.k, r.batch, r.s) for r in out.collect()) == [("a", 0, 0), ("a", 0, 0), ("a", 2, 3), ("b", 1, 0)]


def test_ledger_upkeep(spark):
    rows = ledger(spark, [(0, 1, 5), (0, 2, 5), (0, 3, 6), (0, 4, None), (1, 2, 7)])
    assert sorted((r.k, r.ts) for r in state.compact(rows, ["k"], "v").collect()) == [(0, 1), (0, 3), (0, 4), (1, 2)]
    assert sorted((r.k, r.ts) for r in state.forget_before(rows, ["k"], 2).collect()) == [(0, 2), (0, 3), (0, 4), (1, 2)]
    merged = state.merge_state(rows.na.fill(0), ledger(spark, [(1, 0, 3), (9, 0, 1)]), ["k"], ["v"])
    assert {r.k: r.v for r in merged.collect()} == {0: 16, 1: 10, 9: 1}
    entries = spark.range(50).selectExpr("id as k", "id * 2 as v")
    assert state.random_entry(entries, "k").collect() == state.random_entry(entries.repartition(3), "k").collect()


def test_empty_tables(spark):
    none = ledger(spark, [])
    assert state.running(none, ["k"], {"s": ("sum", F.col("v"))}, split_ms=5).count() == 0
    assert state.asof(none, none.withColumnRenamed("v", "w"), ["k"], ["w"]).count() == 0
    assert [r.s for r in state.running_at_probes(none, [1, 2], {"s": F.col("v")}).collect()] == [0, 0]


def test_plan_of_a_running_read_has_one_exchange(spark):
    """Frames over one key and order share a shuffle and a sort."""
    rows = spark.range(100).selectExpr("id % 7 as k", "id as ts", "id as v")
    out = rows.withColumns({"a": F.sum("v").over(state.frame(["k"])), "b": F.sum("v").over(state.frame(["k"], width_ms=10))})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_bursts_of_a_busy_sender(spark):
    """80,000 messages of one sender in two hours and a half: the work does not grow with what the window holds."""
    n = F.col("id")
    m = spark.range(80_000).select((n * 113).alias("ts"), n.alias("message_id"), F.lit(1).alias("sender"), (n % 9).alias("recipient"), (n % 9 > 5).alias("is_friend"))
    start = time.monotonic()
    found = detectors.nonfriend_bursts(m).agg(F.count("*"), F.min("message_id"), F.max("message_id")).first()
    others = [i for i in range(30) if i % 9 <= 5]
    assert tuple(found) == (80_000 - others[7], others[7], 79_999)
    assert time.monotonic() - start < 60
