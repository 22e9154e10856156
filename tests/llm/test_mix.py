import random
from collections import Counter

import pytest

from tidemark.llm import mix


def test_targets():
    assert [float(x) for x in mix.water_fill([100, 100, 100], [1, 2, 3], 300, 3)] == [50, 100, 150]
    assert [float(x) for x in mix.water_fill([1000, 10, 10], [1, 2, 3], 1020, 3)] == [960, 30, 30]
    assert mix.water_fill([], [], 0, 3) == [] and mix.water_fill([0, 0], [1, 2], 0, 3) == [0, 0]


def brute_cost(patterns, quotas, most):
    """Least cost of the largest flow by trying all splits of small integer patterns."""
    from itertools import product

    splits = []
    for members, size in patterns:
        splits.append([f for f in product(range(most * size + 1), repeat=len(members)) if sum(f) <= most * size])
    best = None
    for pick in product(*splits):
        got, cost = Counter(), 0
        for (members, size), flow in zip(patterns, pick):
            for s, f in zip(members, flow):
                got[s] += f
            cost += sum(i // size for i in range(sum(flow)) if size)
        if all(got[s] <= q for s, q in enumerate(quotas)) and (best is None or (-sum(got.values()), cost) < best):
            best = (-sum(got.values()), cost)
    return best


def test_flow_equals_brute_force():
    rng = random.Random(7)
    for _ in range(40):
        n = rng.randint(1, 3)
        patterns = [(tuple(sorted(rng.sample(range(n), rng.randint(1, min(2, n))))), rng.randint(0, 2)) for _ in range(rng.randint(1, 3))]
        quotas = [rng.randint(0, 5) for _ in range(n)]
        flows = mix.min_cost_flow(patterns, quotas, 3)
        got, cost = Counter(), 0
        for (members, size), flow in zip(patterns, flows):
            assert set(flow) == set(members) and sum(flow.values()) <= 3 * size
            got.update(flow)
            cost += sum(i // size for i in range(sum(flow.values())) if size)
        assert (-sum(got.values()), cost) == brute_cost(patterns, quotas, 3)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        source = rng.choice(["hot"] * 6 + ["a", "b", "c", None, "é", "Z"])
        rows.append((i, "w " * rng.choice([1, 5, 50, 400]), source, 7, "clash"))
    rows += [(9000, None, "a", 0, "x"), (9001, "", "a", 0, "x"), (9002, "x y", "a", 0, "x"), (9002, "x y", "a", 0, "x"), (None, "no id", "b", 0, "x"), (9003, "big " * 20_000, "hot", 0, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, copies string")


def test_sources_come_near_their_targets(spark, docs):
    rows = mix.mix(mix.document_sizes(docs)).collect()
    assert len(rows) == docs.count()
    sizes, taken, targets = Counter(), Counter(), {}
    for r in rows:
        assert 0 <= r.taken == r.copies * r.size and r.copies <= 3
        assert r.size or r.copies == 1
        sizes[tuple(r.pattern)] += r.size
        taken[tuple(r.pattern)] += r.taken
        targets[tuple(r.pattern)] = (r.target, r.source_size)
    want = mix.water_fill([sizes[k] for k in sorted(sizes)], [[1, 2, 3][i % 3] for i in range(len(sizes))], sum(sizes.values()), 3)
    for k, t in zip(sorted(sizes), want):
        assert targets[k] == (float(t), sizes[k])
        assert abs(taken[k] - float(t)) <= max(2, 0.002 * float(t))
    again = mix.mix(mix.document_sizes(docs.repartition(7))).collect()
    assert Counter(map(str, again)) == Counter(map(str, rows))


def test_overlapping_sources(spark):
    rng = random.Random(5)
    rows = [(i, rng.randint(1, 40), rng.choice([["a"], ["b"], ["a", "b"], ["b", "a"], ["a", "b", "c"]])) for i in range(2000)]
    rows += [(5000, None, None), (5001, 3, [])]
    table = spark.createDataFrame(rows, "key long, size long, sources array<string>")
    got = mix.mix(table, share=0.8).collect()
    assert len(got) == len(rows) and all(r.copies <= 3 for r in got)
    total = sum(s or 0 for _, s, _ in rows)
    assert abs(sum(r.taken for r in got) - 0.8 * total) < 0.02 * total


def test_groups_of_sources_flow_apart():
    """Flows of patterns that no source joins add up to those of the whole graph, and a large group is refused."""
    rng = random.Random(2)
    patterns = [((3 * g + a, 3 * g + b) if a < b else (3 * g + a,), rng.randint(0, 50)) for g in range(6) for a, b in ((0, 0), (0, 1), (1, 2), (2, 2))]
    quotas = [rng.randint(0, 120) for _ in range(18)]
    apart, whole = mix.joined_flows(patterns, quotas, 3), mix.min_cost_flow(patterns, quotas, 3)
    cost = lambda flows: sum(sum(i // size for i in range(sum(f.values()))) for (_, size), f in zip(patterns, flows) if size)
    assert sum(sum(f.values()) for f in apart) == sum(sum(f.values()) for f in whole) and cost(apart) == cost(whole)
    with pytest.raises(ValueError):
        mix.joined_flows([((0, i), 1) for i in range(1, mix.MOST_JOINED + 3)], [1] * (mix.MOST_JOINED + 4), 3)


def test_quotas_are_filled_until_nothing_fits(spark):
    """Long documents leave gaps that only many short ones fill; what is still short is told."""
    rows = [(i, 1000, ["a"]) for i in range(20)] + [(100 + i, 7, ["a"]) for i in range(2000)] + [(9000 + i, 900, ["b"]) for i in range(12)]
    got = mix.mix(spark.createDataFrame(rows, "key long, size long, sources array<string>")).collect()
    for s in (0, 1):
        mine = [r for r in got if r.pattern == [s]]
        short = mine[0].target - sum(r.taken for r in mine)
        assert abs(short - mine[0].lack) <= 1
        spare = [r.size for r in mine if r.copies < 3 and r.size]
        assert mine[0].lack <= mix.TOLERANCE * mine[0].target or all(x > mine[0].lack for x in spare)


def test_too_many_patterns_are_refused(spark, monkeypatch):
    monkeypatch.setattr(mix, "MOST_PATTERNS", 2)
    with pytest.raises(ValueError):
        mix.mix(spark.createDataFrame([(i, 1, [str(i)]) for i in range(5)], "key long, size long, sources array<string>"))


def test_empty_table(spark):
    assert mix.mix(spark.createDataFrame([], "key long, size long, sources array<string>")).collect() == []
