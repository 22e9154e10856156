"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold them). On the driver a small graph
carries tokens from each pattern, over one arc per repetition with a cost that rises from copy to copy, to the
quotas of its sources. What each pattern sends to each source is then an interval of tokens, and documents, laid
end to end in a seeded order, are taken once for each interval that holds them whole. What quotas still lack is
filled with further documents that fit, round by round, until nothing more fits or next to nothing is lacking.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Most sources and most membership patterns that are brought to the driver, and most patterns that overlapping sources
#: join into one flow; more raise an error.
MOST_SOURCES, MOST_PATTERNS, MOST_JOINED = 100_000, 100_000, 20_000
#: A quota counts as filled when no more than this share of it is lacking.
TOLERANCE = 0.001
#: Documents laid end to end by one window, about.
BUCKET_DOCS = 256


def water_fill(sizes: list[int], weights: list[int], total: int, most: int) -> list[Fraction]:
    """Shares of ``total`` by weight, none above ``most`` times its size; excess is shared anew by weight."""
    out, active, left = [Fraction(0)] * len(sizes), set(range(len(sizes))), Fraction(total)
    while active:
        scale = left / sum(weights[i] for i in active)
        above = {i for i in active if scale * weights[i] > most * sizes[i]}
        if not above:
            for i in active:
                out[i] = scale * weights[i]
            break
        for i in above:
            out[i] = Fraction(most * sizes[i])
            left -= out[i]
        active -= above
    return out


def min_cost_flow(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], most: int) -> list[dict[int, int]]:
    """Tokens from each pattern (members, size) to each member source: as much as quotas take, at least cost.

    The n-th copy of a token costs n - 1. Successive shortest paths with potentials; arcs are few (patterns times
    members), and every step fills an arc.
    """
    source, sink = 0, 1
    first_pattern, first_quota = 2, 2 + len(patterns)
    graph: list[list[int]] = [[] for _ in range(first_quota + len(quotas))]
    to, room, cost = [], [], []

    def arc(a, b, capacity, price):
        for x, y, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            graph[x].append(len(to))
            to.append(y)
            room.append(c)
            cost.append(p)
        return len(to) - 2

    sent: list[dict[int, int]] = []
    for p, (members, size) in enumerate(patterns):
        for copy in range(most):
            arc(source, first_pattern + p, size, copy)
        sent.append({s: arc(first_pattern + p, first_quota + s, most * size, 0) for s in members})
    for s, quota in enumerate(quotas):
        arc(first_quota + s, sink, quota, 0)
    height = [0] * len(graph)
    while True:
        far, via, heap = [None] * len(graph), [-1] * len(graph), [(0, source)]
        far[source] = 0
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in graph[x]:
                y = to[e]
                if room[e] and (far[y] is None or d + cost[e] + height[x] - height[y] < far[y]):
                    far[y], via[y] = d + cost[e] + height[x] - height[y], e
                    heapq.heappush(heap, (far[y], y))
        if far[sink] is None:
            break
        height = [h if d is None else h + d for h, d in zip(height, far)]
        pushed = True
        while pushed:  # all paths of this length: a blocking flow over arcs of no reduced cost
            pushed = False
            seen, stack, path = [False] * len(graph), [(source, iter(graph[source]))], []
            seen[source] = True
            while stack:
                x, arcs = stack[-1]
                if x == sink:
                    amount = min(room[e] for e in path)
                    for e in path:
                        room[e] -= amount
                        room[e ^ 1] += amount
                    pushed = True
                    cut = next(i for i, e in enumerate(path) if not room[e])
                    for node, _ in stack[cut + 1 :]:  # not dead ends
                        seen[node] = False
                    del stack[cut + 1 :], path[cut:]
                    continue
                for e in arcs:
                    y = to[e]
                    if room[e] and not seen[y] and far[y] is not None and cost[e] + height[x] - height[y] == 0:
                        seen[y] = True
                        stack.append((y, iter(graph[y])))
                        path.append(e)
                        break
                else:
                    stack.pop()
                    if path:
                        path.pop()
    return [{s: room[e ^ 1] for s, e in arcs.items()} for arcs in sent]


def joined_flows(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], most: int) -> list[dict[int, int]]:
    """``min_cost_flow`` of every group of patterns that sources join; groups do not touch, so their flows add up."""
    root = list(range(len(quotas)))

    def find(s: int) -> int:
        while root[s] != s:
            root[s] = root[root[s]]
            s = root[s]
        return s

    for members, _ in patterns:
        for s in members[1:]:
            root[find(s)] = find(members[0])
    groups: dict[int, list[int]] = {}
    for p, (members, _) in enumerate(patterns):
        groups.setdefault(find(members[0]), []).append(p)
    sent: list[dict[int, int]] = [{}] * len(patterns)
    for group in groups.values():
        _bounded(group, MOST_JOINED, "patterns of overlapping sources")
        own = sorted({s for p in group for s in patterns[p][0]})
        at = {s: i for i, s in enumerate(own)}
        flows = min_cost_flow([(tuple(at[s] for s in patterns[p][0]), patterns[p][1]) for p in group], [quotas[s] for s in own], most)
        for p, flow in zip(group, flows):
            sent[p] = {own[i]: f for i, f in flow.items()}
    return sent


def _bounded(rows: list, most: int, what: str) -> list:
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}")
    return rows


def _laid(rows: DataFrame, group: str) -> DataFrame:
    """``rows`` (group, h, key, size, buckets, ...) with x: the sizes before a row when its group is laid end to end.

    The order is by bucket of h, then h, so windows hold ``BUCKET_DOCS`` rows and no group is one task's work.
    """
    placed = rows.withColumn("bucket", F.pmod("h", "buckets").cast("int"))
    before = placed.groupBy(group, "bucket").agg(F.sum("size").alias("sum")).withColumn("base", F.sum("sum").over(W.partitionBy(group).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("sum"))
    within = F.sum("size").over(W.partitionBy(group, "bucket").orderBy("h", "key").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    return placed.withColumn("x", within).join(before.select(group, "bucket", "base"), [group, "bucket"]).withColumn("x", F.col("x") + F.col("base")).drop("bucket", "base")


def mix(rows: DataFrame, weights=(1, 2, 3), share: float = 1.0, most: int = 3, seed: int = 17) -> DataFrame:
    """Take documents so that each source's taken tokens come near its target.

    ``rows``: key long, size long (null: 0), sources array<string> (null elements are a source of their own, which
    comes last; a null or empty array is that source too). Sources by code point weigh ``weights`` in turn and share
    ``share`` of all sizes, none above ``most`` times the size that it holds; the excess goes to the others by weight.

    Returns a row for each row: key, size, pattern (source numbers), copies (0 to ``most``; documents of size 0 are
    kept once), taken (size times copies), source_size, target and lack (the tokens that stay short of the target, where
    no further document fits) of the first source of its pattern. The order is seeded by key and size; equal rows are
    taken alike in any order, so reruns agree. An empty table gives none.
    """
    spark = rows.sparkSession
    rows = rows.select("key", F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size"), F.when(F.size(F.coalesce("sources", F.array())) > 0, F.array_sort(F.array_distinct("sources"))).otherwise(F.array(F.lit(None).cast("string"))).alias("sources"))
    table, table_path = common.materialize(rows.withColumn("h", F.xxhash64("key", "size", F.lit(seed))), "mix-rows")
    held = _bounded(table.groupBy("sources").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).limit(MOST_PATTERNS + 1).collect(), MOST_PATTERNS, "membership patterns")
    names = _bounded(sorted({s for r in held for s in r.sources}, key=lambda s: (s is None, s or "")), MOST_SOURCES, "sources")
    number = {s: i for i, s in enumerate(names)}
    patterns = sorted((tuple(sorted(number[s] for s in r.sources)), r.size, r.n, r.sources) for r in held)
    sizes = [0] * len(names)
    for members, size, *_ in patterns:
        for s in members:
            sizes[s] += size
    total = round(share * sum(p[1] for p in patterns))
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(names))], total, most)
    quotas = [round(t) for t in targets]
    flows = joined_flows([(p[0], p[1]) for p in patterns], quotas, most)

    known = []
    for k, ((members, size, n, sources), flow) in enumerate(zip(patterns, flows)):
        at, spans = 0, []
        for s in members:
            spans.append((s, at, at + flow[s]))
            at += flow[s]
        known.append((k, sources, [*members], size, max(1, -(-n // BUCKET_DOCS)), spans, sizes[members[0]], float(targets[members[0]])))
    schema = "p int, sources array<string>, pattern array<int>, p_size long, buckets int, spans array<struct<s:int,a:long,b:long>>, source_size long, target double"
    facts = F.broadcast(spark.createDataFrame(known, schema))  # at most MOST_PATTERNS rows

    placed = table.join(facts.select("p", F.col("sources").alias("k_sources"), "buckets"), F.col("sources").eqNullSafe(F.col("k_sources"))).select("key", "size", "h", "p", "buckets")
    laid = _laid(placed, "p")
    laid = laid.join(facts.select("p", "pattern", "p_size", "spans", "source_size", "target"), "p")
    holds = lambda s: sum(((F.col("x") + k * F.col("p_size") >= s.a) & (F.col("x") + F.col("size") + k * F.col("p_size") <= s.b)).cast("int") for k in range(most))
    laid = laid.withColumn("given", F.transform("spans", lambda s: F.struct(s.s.alias("s"), holds(s).alias("n"))))
    laid = laid.withColumn("copies", F.when(F.col("size") == 0, 1).otherwise(F.aggregate("given", F.lit(0), lambda z, g: z + g.n)))
    chosen, path = common.materialize(laid.select("key", "size", "h", "p", "x", "pattern", "given", "copies", "source_size", "target"), "mix-laid")
    common.delete_path(spark, table_path)

    taken = chosen.where("size > 0").select("size", F.explode("given").alias("g")).groupBy("g.s").agg(F.sum(F.col("size") * F.col("g.n")).alias("taken")).collect()
    lack, docs_of = [*quotas], [sum(n for members, _, n, _ in patterns if s in members) for s in range(len(names))]
    for r in taken:
        lack[r.s] -= r.taken

    def wanting():
        want = [(s, r, max(1, -(-docs_of[s] // BUCKET_DOCS))) for s, r in enumerate(lack) if r > TOLERANCE * quotas[s]]
        return F.broadcast(spark.createDataFrame(want, "s int, lack long, buckets int")) if want else None

    def fitting(want, turn):
        spare = chosen.where((F.col("copies") + F.size("pattern") <= most) & (F.col("size") > 0))
        return spare.select("key", "size", F.xxhash64("h", F.lit(turn)).alias("h"), "p", F.col("x").alias("at"), F.explode("pattern").alias("s")).join(want, "s").where("size <= lack")

    def add(more):
        """One copy more for each row of ``more`` (p, at)."""
        more = more.groupBy("p", "at").agg(F.count(F.lit(1)).cast("int").alias("more")).withColumnRenamed("at", "x")
        return chosen.join(more, ["p", "x"], "left").withColumn("copies", F.col("copies") + F.when(F.col("size") > 0, F.coalesce("more", F.lit(0))).otherwise(0)).drop("more")

    turn = 0
    while (want := wanting()) is not None:
        # Documents that fit are laid end to end, which adds one at least, and the largest alone if that fills more.
        more, more_path = common.materialize(_laid(fitting(want, turn), "s").where(F.col("x") + F.col("size") <= F.col("lack")), "mix-more")
        added = more.groupBy("s").agg(F.sum("size").alias("sum")).collect()
        best = {r.s: r.b for r in fitting(want, turn).groupBy("s").agg(F.max(F.struct("size", "h", "p", "at")).alias("b")).collect()}
        if not added:
            common.delete_path(spark, more_path)
            break
        alone = [(r.s, best[r.s].p, best[r.s].at) for r in added if best[r.s].size > r["sum"]]
        for r in added:
            lack[r.s] -= max(r["sum"], best[r.s].size)
        if alone:
            single = F.broadcast(spark.createDataFrame(alone, "s int, p int, at long"))
            more = more.join(single.select("s"), "s", "left_anti").select("p", "at").unionByName(single.select("p", "at"))
        newer, newer_path = common.materialize(add(more.select("p", "at")), "mix-laid")
        for old in (path, more_path):
            common.delete_path(spark, old)
        chosen, path, turn = newer, newer_path, turn + 1
    short = F.broadcast(spark.createDataFrame(list(enumerate(lack)), "s int, lack long"))  # at most MOST_SOURCES rows
    out = chosen.join(short, F.col("pattern")[0] == F.col("s"))
    return out.select("key", "size", "pattern", "copies", (F.col("size") * F.col("copies")).alias("taken"), "source_size", "target", "lack")


def document_sizes(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """(key, size in words, sources) of a table of documents with one source column each."""
    return docs.select((F.col("doc_id").cast("long") if key is None else key).alias("key"), common.word_count(F.col("text")).alias("size"), F.array("source").alias("sources"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of ``documents`` with what the mix takes of it.

    Null and empty texts have size 0 and are kept once, taking nothing; rows without a source are a source of their own,
    the last; whole texts are counted; repeated ids and rows have a row each; other columns are ignored; an empty table
    has no rows.
    """
    mixed = mix(document_sizes(common.table(spark, sf_dir, "documents")))
    return mixed.select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken", "copies", "lack")
