"""Streaming editions: exact and lagged detection, running counts in order of time, and windowed word counts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import pair_key, split_words, text_of_words
from ..operators import state as st
from ..plans.detectors import EMAIL_BY_IP, is_simple_spam
from ..sources.files import delete_path

#: Time that one task takes of one key's rows of a batch.
SPLIT_MS = 86_400_000


class BatchSpam:
    """``foreachBatch`` target that judges messages from carried state, as the simple or the address detector does.

    ``lagged=False``: each micro-batch is judged as a full replay would. ``lagged=True``: as a state that is read before
    a batch updates it would have it - friendships and the sender's counts of earlier batches only, and of the address
    what came before each message.

    State is kept as deltas: a batch writes the friendships and the counts it adds to folders of its own under ``path``,
    and every ``compact_every`` batches the state is added up into one base. A batch reads the last base before it and
    the deltas after that, so a batch that runs again writes the same. Totals are all that a later read can see, so
    older versions are forgotten with the deltas: what lies before the base that the last one was made from is deleted.

    Batches must come in order of time; an event not later than all of an earlier batch is an error. ``sink(frame,
    batch_id)`` gets the messages of the batch with is_friend, f, nf and is_spam, and with ``by_address`` also email,
    noemail and is_address_spam. Null keys are keys; an empty batch changes nothing.
    """

    #: Kinds of state: keys, and values with the aggregate that adds them up.
    KINDS = {
        "pairs": ({"lo": "long", "hi": "long"}, {"since": "min"}),
        "sent": ({"sender": "long"}, {"f0": "sum", "nf0": "sum"}),
        "mail": ({"sender_ip": "int"}, {"email0": "sum", "noemail0": "sum"}),
        "seen": ({}, {"last_ts": "max"}),
    }

    def __init__(self, spark: SparkSession, path: str, sink: Callable[[DataFrame, int], None], by_address: bool = False, lagged: bool = False, compact_every: int = 8):
        self.spark, self.path, self.sink = spark, path, sink
        self.by_address, self.lagged, self.every = by_address, lagged, compact_every

    def _base(self, batch: int) -> int:
        """The batch whose base holds all before this batch but the deltas after it; -1 if there is none yet."""
        return batch // self.every * self.every - 1

    def _folded(self, kind: str, parts: DataFrame) -> DataFrame:
        keys, values = self.KINDS[kind]
        return parts.groupBy(*keys).agg(*[getattr(F, how)(v).alias(v) for v, how in values.items()])

    def _load(self, kind: str, batch: int) -> DataFrame:
        """The state before a batch."""
        keys, values = self.KINDS[kind]
        schema, base = ", ".join(f"{n} {t}" for n, t in (keys | dict.fromkeys(values, "long")).items()), self._base(batch)
        paths = [f"{self.path}/base-{base}/{kind}"] * (base >= 0) + [f"{self.path}/delta-{i}/{kind}" for i in range(base + 1, batch)]
        parts = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return self._folded(kind, parts)

    def _kinds(self) -> list[str]:
        return [k for k in self.KINDS if self.by_address or k != "mail"]

    def _add(self, kind: str, delta: DataFrame, batch: int) -> None:
        delta.select(*(n for names in self.KINDS[kind] for n in names)).write.mode("overwrite").parquet(f"{self.path}/delta-{batch}/{kind}")

    def _compact(self, batch: int) -> None:
        if (batch + 1) % self.every:
            return
        for kind in self._kinds():
            # up to and with this batch: the state before the next one, without its base, which is being made
            old, keys, values = self._base(batch), *self.KINDS[kind]
            paths = [f"{self.path}/base-{old}/{kind}"] * (old >= 0) + [f"{self.path}/delta-{i}/{kind}" for i in range(old + 1, batch + 1)]
            schema = ", ".join(f"{n} {t}" for n, t in (keys | dict.fromkeys(values, "long")).items())
            self._folded(kind, self.spark.read.schema(schema).parquet(*paths)).write.mode("overwrite").parquet(f"{self.path}/base-{batch}/{kind}")
        old = self._base(batch)
        for i in range(max(0, old - self.every + 1), old + 1):  # a batch that runs again needs the base ``old`` and what follows
            delete_path(self.spark, f"{self.path}/delta-{i}")
        if old - self.every >= 0:
            delete_path(self.spark, f"{self.path}/base-{old - self.every}")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """``batch``: kind (message or friendship), ts, id, user_a (sender), user_b (recipient)[, ip, mail]."""
        state = {k: self._load(k, batch_id) for k in self._kinds()}
        last = state["seen"].first()
        batch, judged = batch.persist(), None
        try:
            rows = batch if last is None or last.last_ts is None else st.check_no_late_writes(batch, last.last_ts)
            lo, hi = pair_key(F.col("user_a"), F.col("user_b"))
            new = rows.where("kind = 'friendship'").groupBy(lo.alias("lo"), hi.alias("hi")).agg(F.min("ts").alias("since"))
            self._add("pairs", new, batch_id)
            own = [F.col("ip").alias("sender_ip"), "mail"] if self.by_address else []
            m = rows.where("kind = 'message'").select("ts", F.col("id").alias("message_id"), F.col("user_a").alias("sender"), lo.alias("lo"), hi.alias("hi"), *own)
            touched = m.select("lo", "hi").distinct()  # of the state, only the batch's own keys go on
            known = state["pairs"] if self.lagged else self._folded("pairs", state["pairs"].unionByName(new))
            known = known.join(touched, ["lo", "hi"], "left_semi")
            m = m.join(known, ["lo", "hi"], "left").withColumn("is_friend", F.coalesce(F.col("since") <= F.col("ts"), F.lit(False))).drop("lo", "hi", "since")
            judged = m.persist()
            friend = F.col("is_friend").cast("long")
            if self.lagged:
                m = judged.withColumns({"f": F.lit(0).cast("long"), "nf": F.lit(0).cast("long")})
            else:
                m = st.running(judged, ["sender"], {"f": ("sum", friend), "nf": ("sum", 1 - friend)}, split_ms=SPLIT_MS)
            m = self._carried(m, state["sent"], ["sender"], {"f": "f0", "nf": "nf0"}).withColumn("is_spam", is_simple_spam())
            self._add("sent", judged.groupBy("sender").agg(F.sum(friend).alias("f0"), F.sum(1 - friend).alias("nf0")), batch_id)
            if self.by_address:
                mail = F.col("mail").cast("long")
                arrival = {"strict": True, "ties": "rows", "tiebreak": ("message_id",)} if self.lagged else {}
                m = st.running(m, ["sender_ip"], {"email": ("sum", mail), "noemail": ("sum", 1 - mail)}, split_ms=SPLIT_MS, **arrival)
                m = self._carried(m, state["mail"], ["sender_ip"], {"email": "email0", "noemail": "noemail0"})
                m = m.withColumn("is_address_spam", F.col("is_spam") & F.coalesce(F.col("email") / F.nullif(F.col("email") + F.col("noemail"), F.lit(0)) > EMAIL_BY_IP, F.lit(False)))
                self._add("mail", judged.groupBy("sender_ip").agg(F.sum(mail).alias("email0"), F.sum(1 - mail).alias("noemail0")), batch_id)
            self._add("seen", rows.agg(F.max("ts").alias("last_ts")), batch_id)
            self.sink(m, batch_id)
            self._compact(batch_id)
        finally:
            batch.unpersist()
            if judged is not None:
                judged.unpersist()

    @staticmethod
    def _carried(m: DataFrame, state: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
        """Counts of the batch with what the state has of each key added."""
        out = m.join(state.withColumnsRenamed({k: f"__{k}" for k in keys}), reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), "left")
        return out.withColumns({n: F.col(n) + F.coalesce(c, F.lit(0)) for n, c in columns.items()}).drop(*columns.values(), *[f"__{k}" for k in keys])


class ExactSimpleSpam(BatchSpam):
    """The simple detector, exact."""


def lagged_counts(messages: DataFrame) -> DataFrame:
    """A stream of messages (ts, message_id, sender, is_friend) with the sender's counts of *earlier* micro-batches.

    State is read before the batch updates it, so all of a batch's messages of a sender see the same counts.
    """

    def step(key, batches, state):
        f, nf = state.get if state.exists else (0, 0)
        seen_f, seen_nf = f, nf
        for b in batches:
            f, nf = f + int(b["is_friend"].sum()), nf + int((~b["is_friend"]).sum())
            yield b.assign(f=seen_f, nf=seen_nf)[["ts", "message_id", "sender", "is_friend", "f", "nf"]]
        state.update((f, nf))

    out, kept = "ts long, message_id long, sender long, is_friend boolean, f long, nf long", "f long, nf long"
    return messages.groupBy("sender").applyInPandasWithState(step, out, kept, "append", "NoTimeout")


def ordered_running_count(events: DataFrame, key: str, delay: str = "10 seconds") -> DataFrame:
    """A stream with each event's running count of its key by event time: (key, ts_time, id, cnt), ties counted together.

    ``events``: key, ts_time timestamp, id. Events wait until the watermark passes them and are then counted in
    order; later ones are dropped. State is the count and what waits.
    """

    def step(k, batches, state):
        count, times, ids = state.get if state.exists else (0, [], [])
        waiting = pd.concat([pd.DataFrame({"ts_time": pd.to_datetime(pd.Series(times, dtype="int64"), unit="us"), "id": pd.Series(ids, dtype="int64")}), *[b[["ts_time", "id"]] for b in batches]], ignore_index=True)
        mark = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
        ready = waiting[waiting["ts_time"] <= mark].sort_values(["ts_time", "id"])
        if len(ready):
            counts = count + ready["ts_time"].rank(method="max").astype(int)
            yield pd.DataFrame({key: k[0], "ts_time": ready["ts_time"], "id": ready["id"], "cnt": counts})
        waiting = waiting[waiting["ts_time"] > mark]
        state.update((count + len(ready), [int(x) for x in waiting["ts_time"].astype("datetime64[us]").astype("int64")], [int(x) for x in waiting["id"]]))
        if len(waiting):
            state.setTimeoutTimestamp(int(waiting["ts_time"].min().timestamp() * 1000) + 1)

    kind = events.schema[key].dataType.simpleString()
    return events.withWatermark("ts_time", delay).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, ts_time timestamp, id long, cnt long", "n long, times array<long>, ids array<long>", "append", "EventTimeTimeout")


def word_windows(texts: DataFrame, width: str = "30 seconds", slide: str = "10 seconds", delay: str = "10 seconds") -> DataFrame:
    """A stream of word counts over sliding windows: (start, end, word, cnt). ``texts``: ts_time timestamp, text."""
    words = texts.withWatermark("ts_time", delay).select("ts_time", F.explode(split_words(F.col("text"))).alias("word"))
    counts = words.groupBy(F.window("ts_time", width, slide).alias("w"), "word").agg(F.count(F.lit(1)).alias("cnt"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "word", "cnt")


class WindowTopWords:
    """``foreachBatch`` target that gives ``sink(frame, batch_id)`` the k commonest words (start, end, word, cnt) of windows.

    A window's words come together, with the batch that moves the watermark (the latest time so far less ``delay``) to its
    end or past it; ties go by word. What comes later for a window is dropped. Batches: ts_time timestamp, text; null times
    and texts have no words.

    State is what later batches need and no more: the texts with a window that is still open, and the latest time. Each
    batch writes its own under ``path`` and reads that of the batch before, so a batch that runs again does the same.
    Texts are dealt by time, ``DEALT`` windows together, and counted where they lie: a word is never moved by itself, and a
    task holds the distinct words of ``DEALT`` windows.
    """

    DEALT = 32

    def __init__(self, spark: SparkSession, path: str, sink: Callable[[DataFrame, int], None], k: int = 20, width: str = "30 seconds", slide: str = "10 seconds", delay: str = "10 seconds"):
        self.spark, self.path, self.sink, self.k = spark, path, sink, k
        micros = lambda d: F.unix_micros(F.expr(f"timestamp_seconds(0) + interval '{d}'"))
        self.width, self.slide, self.delay = spark.range(1).select(micros(width), micros(slide), micros(delay)).first()

    def _starts(self, after: int | None, upto: int | None = None):
        """The starts of a time's windows that end after some time (and up to another), from column ts."""
        last = F.floor(F.col("ts") / self.slide) * self.slide
        all_starts = F.transform(F.sequence(F.lit(0), F.lit(-(-self.width // self.slide) - 1)), lambda i: last - i * self.slide)
        wanted = lambda s: (s > F.col("ts") - self.width) & (F.lit(True) if after is None else s + self.width > after) & (F.lit(True) if upto is None else s + self.width <= upto)
        return F.filter(all_starts, wanted)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        rows = batch.where("ts_time is not null").select(F.unix_micros("ts_time").alias("ts"), "text")
        mark = rows.agg(F.max("ts")).first()[0]
        old, passed = None, None
        if batch_id:
            old = self.spark.read.schema("ts long").parquet(f"{self.path}/latest-{batch_id - 1}").first()[0]
            rows = rows.where(F.size(self._starts(None if old is None else old - self.delay)) > 0)
            rows = rows.unionByName(self.spark.read.schema("ts long, text string").parquet(f"{self.path}/open-{batch_id - 1}"))
        mark = max((m for m in (mark, old) if m is not None), default=None)
        passed, before = None if mark is None else mark - self.delay, None if old is None else old - self.delay
        self.spark.createDataFrame([(mark,)], "ts long").write.mode("overwrite").parquet(f"{self.path}/latest-{batch_id}")
        rows.where(F.size(self._starts(passed)) > 0).coalesce(8).write.mode("overwrite").parquet(f"{self.path}/open-{batch_id}")
        if passed is not None:
            self.sink(self._top(rows.withColumn("starts", self._starts(before, passed))), batch_id)
        for kind in ("latest", "open"):
            delete_path(self.spark, f"{self.path}/{kind}-{batch_id - 2}")

    def _top(self, rows: DataFrame) -> DataFrame:
        """The commonest words of the windows at ``starts``."""
        deal = lambda s: F.floor(s / (self.slide * self.DEALT))
        parts = F.explode(F.array_distinct(F.transform("starts", deal))).alias("part")
        dealt = rows.select("starts", text_of_words(F.col("text")).alias("text"), parts).where("text is not null").repartition("part").sortWithinPartitions("part")
        own = F.filter("starts", lambda s: deal(s) == F.col("part"))  # neighbours, the last one first
        slide, k = self.slide, self.k

        def best(slots):
            windows: dict[int, Counter] = {}
            for (last, n), words in slots.items():
                for i in range(n):
                    windows.setdefault(last - i * slide, Counter()).update(words)
            for start, words in windows.items():
                counts = np.fromiter(words.values(), np.int64, len(words))
                least = np.partition(counts, -k)[-k] if len(counts) > k else 0
                found = sorted((-n, w) for w, n in words.items() if n >= least)[:k]
                yield pa.record_batch([pa.array([start] * len(found), pa.int64()), pa.array([w for _, w in found], pa.string()), pa.array([-n for n, _ in found], pa.int64())], ["start", "word", "cnt"])

        def count(batches):
            now, slots = None, {}
            for batch in batches:
                for part, last, n, text in zip(*(c.to_pylist() for c in batch.columns)):
                    if part != now:
                        yield from best(slots)
                        now, slots = part, {}
                    slots.setdefault((last, n), Counter()).update(text.split(" "))
            yield from best(slots)

        top = dealt.select("part", F.get(own, 0).alias("last"), F.size(own).alias("n"), "text").mapInArrow(count, "start long, word string, cnt long")
        return top.select(F.timestamp_micros("start").alias("start"), F.timestamp_micros(F.col("start") + self.width).alias("end"), "word", "cnt")


def window_top_words(texts: DataFrame, sink: Callable[[DataFrame, int], None], path: str, k: int = 20, width: str = "30 seconds", slide: str = "10 seconds", delay: str = "10 seconds"):
    """A stream writer that gives ``sink(frame, batch_id)`` the k commonest words (start, end, word, cnt) of each window.

    As ``WindowTopWords``, whose state is kept under ``path``. ``texts``: ts_time timestamp, text.
    """
    return texts.writeStream.outputMode("append").foreachBatch(WindowTopWords(texts.sparkSession, path, sink, k, width, slide, delay))
