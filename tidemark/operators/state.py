"""Versioned state as DataFrames: what a strictly sequential replay would read at each event's own time.

A state is a ledger of updates (keys, ts, value). Reading it "as of" a time folds all updates up to that time,
those of the same time included; ``strict`` leaves them out. Reads on the ledger's own rows are windows; reads from
other rows go through ``asof``, a union and a window, so nothing is joined by inequality. ``split_ms`` cuts each
key's time into buckets with carried totals, so a key that holds a third of all rows is many tasks' work. Such a read
uses its rows twice, for the totals and for the windows: rows that are more than a scan are ``settled`` first, so that
reads upon reads do not run everything before them over and over.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import scratch_path

#: How an aggregate's value before a bucket and within it combine; nulls count as nothing.
_COMBINE = {
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "count": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "min": F.least,
    "max": F.greatest,
}
_OVER = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
_AGG = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def frame(keys: list[str], ts: str = "ts", width_ms: int | None = None, strict: bool = False, ties: str = "range", tiebreak: tuple[str, ...] = ()):
    """The window of one read: all updates of the keys up to ts, or those in (ts - width, ts].

    ``ties="range"`` shows all updates of the same time to each other; ``"rows"`` follows arrival by tiebreak.
    """
    part = W.partitionBy(*keys)
    if ties == "rows":
        if width_ms is not None:
            raise ValueError("a width needs ties='range'")
        return part.orderBy(ts, *tiebreak).rowsBetween(W.unboundedPreceding, -1 if strict else 0)
    low = W.unboundedPreceding if width_ms is None else -(width_ms - 1)
    return part.orderBy(ts).rangeBetween(low, -1 if strict else 0)


def running(rows: DataFrame, keys: list[str], aggs: dict[str, tuple[str, Column]], ts: str = "ts", strict: bool = False, split_ms: int | None = None, ties: str = "range", tiebreak: tuple[str, ...] = (), settle: bool = False) -> DataFrame:
    """``rows`` with running aggregates: name -> (sum, count, min or max, expression).

    Sums and counts are 0 and others null before the first update. With ``split_ms`` the window runs within
    (keys, ts div split_ms) and totals of earlier buckets are joined on; sums must then be of whole numbers. With
    ``settle`` the rows, which that uses twice, are written first. Null keys are a key, and null times come before all others.
    """
    if split_ms is None:
        w = frame(keys, ts, strict=strict, ties=ties, tiebreak=tiebreak)
        out = {n: _AGG[kind](e).over(w) for n, (kind, e) in aggs.items()}
        return rows.withColumns({n: F.coalesce(c, F.lit(0)) if aggs[n][0] in ("sum", "count") else c for n, c in out.items()})
    b = "__bucket"
    placed, dealt = _never_null((settled(rows) if settle else rows).withColumn(b, F.coalesce(F.floor(F.col(ts) / split_ms), F.lit(-(1 << 62)))), keys)
    totals = placed.groupBy(*dealt, b).agg(*[_AGG[kind](e).alias(f"__{n}") for n, (kind, e) in aggs.items()])
    earlier = W.partitionBy(*dealt).orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(*dealt, b, *[_OVER[kind](f"__{n}").over(earlier).alias(f"__{n}") for n, (kind, _) in aggs.items()])
    w = frame([*dealt, b], ts, strict=strict, ties=ties, tiebreak=tiebreak)
    within = placed.withColumns({n: _AGG[kind](e).over(w) for n, (kind, e) in aggs.items()})
    joined = within.join(before, [*dealt, b])  # rows lie as their windows left them
    out = joined.withColumns({n: _COMBINE[kind](F.col(f"__{n}"), F.col(n)) for n, (kind, _) in aggs.items()})
    return out.drop(b, *dealt, *[f"__{n}" for n in aggs])


def settled(rows: DataFrame) -> DataFrame:
    """``rows`` written once to the session's shared folder and read back: whoever uses them more than once scans a table."""
    path = scratch_path(rows.sparkSession, "settled")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _never_null(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """``rows`` with columns that tell the same keys apart and are never null, and the names of these.

    Windows and joins over them need nothing null-safe, so a join finds rows where a window has put them.
    """
    made: dict[str, Column] = {}
    for i, k in enumerate(keys):
        kind = rows.schema[k].dataType
        blank = F.lit(0).cast(kind) if isinstance(kind, T.NumericType) else F.lit("") if isinstance(kind, T.StringType) else None
        if blank is None:
            made[f"__key{i}"] = F.struct(F.col(k))
        else:
            made |= {f"__key{i}": F.coalesce(F.col(k), blank), f"__none{i}": F.col(k).isNull()}
    return rows.withColumns(made), [*made]


def sliding(rows: DataFrame, keys: list[str], aggs: dict[str, tuple], ts: str = "ts", split: bool = True, strict: bool = False) -> DataFrame:
    """``rows`` with aggregates over (ts - width, ts] of their keys: name -> ("count" or "distinct", expression, width in
    ms), or (aggregate expression, width).

    Counts, of values or of distinct ones that are not null, add up what comes in and goes out, so their work does not
    grow with what a window holds. Spark goes over all of a window's rows again at each row for the others, which are for
    narrow windows. ``strict`` leaves out what is at ts itself. Null times are one time, before all others.

    With ``split`` rows go to their own and the next time bucket of the longest width, so a key's windows are dealt
    by time; all widths share that shuffle and its sort.
    """
    framed = {n: a[0].over(frame([*keys, "__bucket"] if split else keys, ts, a[1], strict)) for n, a in aggs.items() if len(a) == 2}
    counted = {n: a for n, a in aggs.items() if len(a) == 3}
    if not split:
        out = rows.withColumns(framed)
        out = _counted(out.withColumn("__bucket", F.col(ts).isNull()), [*keys, "__bucket"], counted, ts, strict) if counted else out
        return out.select(*rows.columns, *aggs)
    longest = max(a[-1] for a in aggs.values())
    ahead = F.when(F.col(ts).isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    twice = rows.withColumn("__ahead", F.explode(ahead)).withColumn("__bucket", F.floor(F.col(ts) / longest) + F.col("__ahead"))
    out = twice.withColumns(framed)
    if counted:
        out = _counted(out, [*keys, "__bucket"], counted, ts, strict, (F.col("__bucket") + 1) * longest)
    return out.where("__ahead = 0").select(*rows.columns, *aggs)


def _counted(rows: DataFrame, part: list[str], aggs: dict[str, tuple], ts: str, strict: bool, end: Column | None = None) -> DataFrame:
    """``rows`` with counts over (ts - width, ts] of their ``part``: name -> ("count" or "distinct", expression, width).

    Every row comes in at its time and goes out a width later; counts are running sums over both. Of the rows of one
    value, only those come in that find none within the width before them, and those go out that none follows within it.
    No row is read at ``end`` or later.
    """
    names, come, go = rows.columns, {}, {}
    for i, (n, (kind, value, width)) in enumerate(aggs.items()):
        some = value.isNotNull()
        if kind == "distinct":
            rows = rows.withColumn(f"__value{i}", value)
            w = W.partitionBy(*part, f"__value{i}").orderBy(ts)
            near = lambda f, gap: f(F.lit(1)).over(w).isNotNull() & F.coalesce(gap(f(ts).over(w)) < width, F.lit(True))  # noqa: E731, B023
            rows = rows.withColumns({f"__come{i}": some & ~near(F.lag, lambda t: F.col(ts) - t), f"__go{i}": some & ~near(F.lead, lambda t: t - F.col(ts))})
            come[n], go[n] = F.col(f"__come{i}").cast("long"), F.col(f"__go{i}").cast("long")
        else:
            come[n] = go[n] = some.cast("long")
    whole = F.struct(*[F.col(f"`{c}`") for c in names])
    at, zero = F.col(ts).cast("long"), F.lit(0).cast("long")
    steps = [F.struct(F.lit(True).alias("read"), at.alias("at"), *[c.alias(f"__{n}") for n, c in come.items()])]
    for width in sorted({width for _, _, width in aggs.values()}):
        gone = [(-go[n] if a[2] == width else zero).alias(f"__{n}") for n, a in aggs.items()]
        steps.append(F.struct(F.lit(False).alias("read"), (at + (width - 1 if strict else width)).alias("at"), *gone))
    matters = lambda s: s["read"] | ((s["at"] < (F.lit((1 << 63) - 1) if end is None else end)) & reduce(lambda a, b: a | b, [s[f"__{n}"] != 0 for n in aggs]))
    laid = rows.select(*part, whole.alias("__row"), F.explode(F.filter(F.array(*steps), matters)).alias("__step"))
    laid = laid.select(*part, F.when(F.col("__step.read"), F.col("__row")).alias("__row"), F.col("__step.at").alias("__at"), *[f"__step.__{n}" for n in aggs])
    w = W.partitionBy(*part).orderBy("__at").rangeBetween(W.unboundedPreceding, -1 if strict else W.currentRow)
    sums = laid.withColumns({f"__{n}": F.coalesce(F.sum(f"__{n}").over(w), zero) for n in aggs})
    return sums.where("__row is not null").select("__row.*", *[F.col(f"__{n}").alias(n) for n in aggs])


def _with_reads(reads: DataFrame, ledger: DataFrame, keys: list[str], columns: dict[str, Column], ts: str) -> DataFrame:
    """Both sides under one another: (keys, ts, __read with all of a read's columns, or the ledger's columns)."""
    whole = F.struct(*[F.col(f"`{n}`") for n in reads.columns])
    side = ledger.select(*keys, ts, *[c.alias(n) for n, c in columns.items()])
    return reads.select(*keys, ts, whole.alias("__read")).unionByName(side, allowMissingColumns=True)


def asof(reads: DataFrame, ledger: DataFrame, keys: list[str], values: list[str], ts: str = "ts", strict: bool = False, within_ms: int | None = None, split_ms: int | None = None, settle: bool = False) -> DataFrame:
    """``reads`` with the ledger's last values at or before each read's time, null if there is none.

    ``keys`` and ``ts`` are named alike on both sides. ``within_ms`` takes only updates younger than that. Of
    several updates at one time the largest (by ``values`` in turn) is taken. One union and a running maximum, no
    inequality join; ``split_ms`` and ``settle`` as in ``running``.
    """
    both = _with_reads(reads, ledger, keys, {"__v": F.struct(F.col(ts).alias("at"), *values)}, ts)
    out = running(both, keys, {"__f": ("max", F.col("__v"))}, ts, strict, split_ms, settle=settle).where("__read is not null")
    if within_ms is not None:
        out = out.withColumn("__f", F.when(F.col("__f.at") > F.col(ts) - within_ms, F.col("__f")))
    return out.select("__read.*", *[F.col(f"__f.{v}").alias(v) for v in values], F.col("__f.at").alias("found_ts"))


def asof_running(reads: DataFrame, ledger: DataFrame, keys: list[str], aggs: dict[str, tuple[str, str]], ts: str = "ts", strict: bool = False, width_ms: int | None = None, split_ms: int | None = None, settle: bool = False) -> DataFrame:
    """``reads`` with aggregates (kind, ledger column) of all ledger rows up to each read; null if there are none.

    Kinds: sum, count, min, max, avg and set. With a width, updates of (ts - width, ts] count, dealt by time.
    Without one, ``split_ms`` and ``settle`` work as in ``running`` for all kinds but sets, which are whole in every row
    and so for small states.
    """
    cols = sorted({c for _, c in aggs.values()})
    both = _with_reads(reads, ledger, keys, {f"__{c}": F.col(c) for c in cols} | {"__n": F.lit(1)}, ts)
    kind = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "avg": F.avg, "set": F.collect_set}
    if width_ms is not None:
        want = {f"__out_{n}": ("count", F.col(f"__{c}"), width_ms) if k == "count" else (kind[k](f"__{c}"), width_ms) for n, (k, c) in aggs.items()}
        out = sliding(both, keys, want | {"__seen": ("count", F.col("__n"), width_ms)}, ts, strict=strict)
    elif any(k == "set" for k, _ in aggs.values()):
        w = frame(keys, ts, strict=strict)
        out = both.withColumns({f"__out_{n}": kind[k](f"__{c}").over(w) for n, (k, c) in aggs.items()} | {"__seen": F.count("__n").over(w)})
    else:
        want = {"__seen": ("count", F.col("__n"))}
        for n, (k, c) in aggs.items():
            want |= {f"__sum_{n}": ("sum", F.col(f"__{c}")), f"__cnt_{n}": ("count", F.col(f"__{c}"))} if k in ("avg", "sum") else {f"__out_{n}": (k, F.col(f"__{c}"))}
        out = running(both, keys, want, ts, strict, split_ms, settle=settle)
        for n, (k, _) in aggs.items():
            if k in ("avg", "sum"):
                value = F.col(f"__sum_{n}") / F.col(f"__cnt_{n}") if k == "avg" else F.col(f"__sum_{n}")
                out = out.withColumn(f"__out_{n}", F.when(F.col(f"__cnt_{n}") > 0, value))
    return out.where("__read is not null").select("__read.*", *[F.when(F.col("__seen") > 0, F.col(f"__out_{n}")).alias(n) for n in aggs])


def _fold_step(ops: dict[str, tuple], z: Column, op: Column, arg: Column) -> Column:
    out = z
    for name, f in ops.items():
        out = F.when(op == name, f(z, arg)).otherwise(out)
    return out


def ordered_fold(ledger: DataFrame, keys: list[str], ops: dict[str, tuple], default, value_type: str, order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """The value of each key after all its updates in order: (keys, value).

    Ledger columns: keys, order, op (a name of ``ops``) and arg; ``ops`` maps names to two-argument column
    functions. For updates that do not commute; those that do have ``running``. A key's updates are gathered in one
    row, so this is for keys with few of them.
    """
    gathered = ledger.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, "op", "arg"))).alias("u"))
    step = lambda z, u: _fold_step(ops, z, u["op"], u["arg"]).cast(value_type)
    return gathered.select(*keys, F.aggregate("u", F.lit(default).cast(value_type), step).alias("value"))


def asof_fold(reads: DataFrame, ledger: DataFrame, keys: list[str], ops: dict[str, tuple], default, value_type: str, order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """``reads`` (keys, read_ts, ...) with the folded value of all updates up to read_ts, null if there are none.

    Each update is applied once: a key's updates and distinct read times are gathered in one row and walked through in
    order, the updates of a time before its reads. Null keys read nothing.
    """
    ts, *rest = order
    kinds = dict(ledger.dtypes)
    updates = ledger.select(*keys, F.struct(F.col(ts).alias("ts"), F.lit(0).alias("read"), *rest, "op", "arg").alias("e"))
    blank = [F.lit(None).cast(kinds[c]).alias(c) for c in (*rest, "op", "arg")]
    times = reads.select(*keys, "read_ts").distinct().select(*keys, F.struct(F.col("read_ts").cast(kinds[ts]).alias("ts"), F.lit(1).alias("read"), *blank).alias("e"))
    walked = updates.unionByName(times).groupBy(*keys).agg(F.array_sort(F.collect_list("e")).alias("e"))
    found = f"array<struct<read_ts:{kinds[ts]},value:{value_type}>>"
    state = f"struct<value:{value_type},n:bigint,found:{found}>"
    start = F.struct(F.lit(default).cast(value_type).alias("value"), F.lit(0).cast("long").alias("n"), F.array().cast(found).alias("found")).cast(state)

    def step(z, e):
        seen = F.struct(e["ts"].alias("read_ts"), F.when(z["n"] > 0, z["value"]).alias("value"))
        read = F.struct(z["value"].alias("value"), z["n"].alias("n"), F.concat(z["found"], F.array(seen).cast(found)).alias("found")).cast(state)
        update = F.struct(_fold_step(ops, z["value"], e["op"], e["arg"]).cast(value_type).alias("value"), (z["n"] + 1).alias("n"), z["found"].alias("found")).cast(state)
        return F.when(e["read"] == 1, read).otherwise(update)

    values = walked.select(*keys, F.inline(F.aggregate("e", start, step)["found"]))
    return reads.join(values, [*keys, "read_ts"], "left")


def mark_first(rows: DataFrame, keys: list[str], name: str, ts: str = "ts", id: str = "message_id") -> DataFrame:
    """``rows`` with 1 on the first row of each key, by ts and id, else 0: its running sum counts distinct keys so far.

    Firsts are found by partial aggregation and met by id, which must be unique, so a hot key is no one task's work.
    """
    firsts = rows.groupBy(*keys).agg(F.min(F.struct(ts, id)).alias("__first")).select(F.col(f"__first.{id}").alias(id), F.lit(1).alias(name))
    return rows.join(firsts, id, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def sliding_at_probes(rows: DataFrame, probes: list[int], aggs: list[Column], width_ms: int, groups: tuple[str, ...] = (), ts: str = "ts") -> DataFrame:
    """Aggregates over (probe - width, probe] at each of some times: (probe_ts, groups, aggs).

    Each row is repeated for the probes that see it and for no others. Probes that see no row have no row.
    """
    times = F.array(*[F.lit(p).cast("long") for p in sorted(probes)])
    sees = F.filter(times, lambda p: (p >= F.col(ts)) & (p < F.col(ts) + width_ms))
    seen = rows.withColumn("probe_ts", F.explode(sees))
    return seen.groupBy("probe_ts", *groups).agg(*aggs)


def running_at_probes(rows: DataFrame, probes: list[int], values: dict[str, Column], groups: tuple[str, ...] = (), ts: str = "ts", fold: str = "sum") -> DataFrame:
    """Running sums (or minima or maxima) at each of some times: (probe_ts, groups, values).

    Rows are folded by the first probe that sees them (in part in each task), then along the probes. Before the
    first row of a group sums are 0 and others null.
    """
    times = F.array(*[F.lit(p).cast("long") for p in sorted(probes)])
    slot = F.get(F.filter(times, lambda p: p >= F.col(ts)), 0)
    totals = rows.withColumn("probe_ts", slot).where("probe_ts is not null").groupBy("probe_ts", *groups).agg(*[_AGG[fold](c).alias(n) for n, c in values.items()])
    if groups:
        frame_of = totals.select(*groups).distinct().withColumn("probe_ts", F.explode(times))
    else:
        frame_of = rows.sparkSession.createDataFrame([(p,) for p in sorted(probes)], "probe_ts long")
    dense = frame_of.join(totals, ["probe_ts", *groups], "left")
    w = W.partitionBy(*groups).orderBy("probe_ts").rowsBetween(W.unboundedPreceding, 0)
    folded = {n: _AGG[fold](n).over(w) for n in values}
    return dense.select("probe_ts", *groups, *[(F.coalesce(c, F.lit(0)) if fold == "sum" else c).alias(n) for n, c in folded.items()])


def running_total(rows: DataFrame, aggs: dict[str, tuple[str, Column]], bucket_ms: int, ts: str = "ts", strict: bool = False, settle: bool = False) -> DataFrame:
    """Running aggregates over all rows, without a key: totals of time buckets, then windows within buckets."""
    return running(rows.withColumn("__all", F.lit(0)), ["__all"], aggs, ts, strict, bucket_ms, settle=settle).drop("__all")


def top_k(state: DataFrame, k: int, value: str, key: str, groups: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """The k largest values (of each group), ties by ascending key; ``most`` caps k as a maintained list would."""
    k = min(k, most) if most is not None else k
    if not groups:
        return state.orderBy(F.desc(value), key).limit(k)
    rank = F.row_number().over(W.partitionBy(*groups).orderBy(F.desc(value), key))
    return state.withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__rank")


def random_entry(state: DataFrame, key: str, seed: int = 1) -> DataFrame:
    """One entry, by the smallest seeded digest of its key: the same one on every run, and in every engine."""
    return state.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(1)


def lagged(rows: DataFrame, keys: list[str], batch: str, sums: dict[str, Column]) -> DataFrame:
    """``rows`` with sums over the earlier batches of their keys only, as a reader of last batch's state sees them."""
    totals = rows.groupBy(*keys, batch).agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    w = W.partitionBy(*keys).orderBy(batch).rangeBetween(W.unboundedPreceding, -1)
    before = totals.select(*keys, batch, *[F.coalesce(F.sum(f"__{n}").over(w), F.lit(0)).alias(n) for n in sums])
    return rows.join(before, [*keys, batch])


def merge_state(state: DataFrame, delta: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """A keyed state of sums with a delta added in: rows of either side stay."""
    return state.select(*keys, *columns).unionByName(delta.select(*keys, *columns)).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in columns])


def compact(ledger: DataFrame, keys: list[str], value: str, ts: str = "ts", split_ms: int | None = 604_800_000) -> DataFrame:
    """A ledger of values without the rows that repeat the value before them; times of a key differ.

    The value before is a strict running maximum of (ts, value), dealt by time.
    """
    seen = running(ledger, keys, {"__last": ("max", F.struct(F.col(ts).alias("at"), F.col(value).alias("v")))}, ts, strict=True, split_ms=split_ms)
    return seen.where(F.col("__last").isNull() | ~F.col("__last.v").eqNullSafe(F.col(value))).drop("__last")


def forget_before(ledger: DataFrame, keys: list[str], frontier: int, ts: str = "ts") -> DataFrame:
    """A ledger without versions that no read at or after the frontier can see: the newest one up to it stays.

    The newest ones are found by partial aggregation, so a hot key is no one task's work.
    """
    placed, dealt = _never_null(ledger, keys)
    newest = placed.where(F.col(ts) <= frontier).groupBy(*dealt).agg(F.max(ts).alias("__newest"))
    kept = placed.join(newest, dealt, "left").where((F.col(ts) > frontier) | (F.col(ts) == F.col("__newest")))
    return kept.select(*ledger.columns)


def late_writes(writes: DataFrame, batch: str, ts: str = "ts") -> DataFrame:
    """The writes that are not later than every write of the batches before theirs, from one total a batch."""
    top = writes.groupBy(batch).agg(F.max(ts).alias("__top"))
    seen = top.select(batch, F.max("__top").over(W.orderBy(batch).rowsBetween(W.unboundedPreceding, -1)).alias("__seen"))
    return writes.join(seen, batch).where(F.col(ts) <= F.col("__seen")).drop("__seen")


def check_no_late_writes(writes: DataFrame, last_read: int, ts: str = "ts") -> DataFrame:
    """The writes, with an error at run time if one is not later than what has been read."""
    late = F.when(F.col(ts) <= last_read, F.raise_error(F.concat(F.lit("late write at "), F.col(ts).cast("string")))).otherwise(F.lit(True))
    return writes.where(late)
