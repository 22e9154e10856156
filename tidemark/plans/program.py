"""Declarative programs: rules over event tables that read and write versioned states.

A rule belongs to one event table. It reads states as of the event's time (each read becomes a column), computes
columns, and writes updates to states. ``compile`` orders rules into phases so that every reader comes after all
writers of what it reads; ``run`` turns the phases into one DataFrame per rule. Several rules may share a table;
every one of them fires.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.durations import days
from ..operators import state as st


class ProgramError(ValueError):
    pass


@dataclass(frozen=True)
class State:
    """A keyed state: how updates fold (sum, count, min, max, avg or set), and how long an update counts, if limited.

    ``keys`` are names with Spark types, such as ("user long",). ``split_ms`` is the time that one task takes of one
    key's updates and reads; a state without keys is one key, so it needs that most.
    """

    name: str
    fold: str
    keys: tuple[str, ...] = ()
    width_ms: int | None = None
    split_ms: int = days(1)

    @property
    def key_names(self) -> list[str]:
        return [k.split()[0] for k in self.keys] or ["__all"]


@dataclass
class Read:
    state: str
    keys: tuple[Column, ...] = ()
    default: object = None
    strict: bool = False


@dataclass
class Write:
    state: str
    keys: tuple[Column, ...] = ()
    value: Column | None = None
    when: Column | None = None


@dataclass
class Rule:
    name: str
    events: str
    reads: dict[str, Read] = field(default_factory=dict)
    columns: dict[str, Column] = field(default_factory=dict)
    writes: list[Write] = field(default_factory=list)
    extends: str | None = None


class Program:
    def __init__(self, *states: State):
        self.states = {s.name: s for s in states}
        self.rules: dict[str, Rule] = {}

    def rule(self, name: str, events: str, reads: dict[str, Read] | None = None, columns: dict[str, Column] | None = None, writes: list[Write] | None = None, extends: str | None = None) -> Program:
        """Add a rule. ``extends`` names a rule on the same table whose columns this one goes on with: what two rules
        tell each other about one event is a column of its row."""
        if name in self.rules:
            raise ProgramError(f"rule {name} is there already")
        self.rules[name] = Rule(name, events, reads or {}, columns or {}, writes or [], extends)
        return self

    def compile(self) -> list[list[str]]:
        """Rule names by phase. Reading and writing one state in a rule, or in a circle of rules, is an error; so is
        reading a state that nothing writes."""
        writers: dict[str, set[str]] = {}
        for r in self.rules.values():
            for x in [*r.reads.values(), *r.writes]:
                if x.state not in self.states:
                    raise ProgramError(f"rule {r.name} uses the unknown state {x.state}")
            for w in r.writes:
                writers.setdefault(w.state, set()).add(r.name)
        needs: dict[str, set[str]] = {}
        for r in self.rules.values():
            needs[r.name] = set()
            if r.extends:
                if r.extends not in self.rules or self.rules[r.extends].events != r.events:
                    raise ProgramError(f"rule {r.name} extends no rule of its table")
                needs[r.name].add(r.extends)
            for x in r.reads.values():
                if x.state not in writers:
                    raise ProgramError(f"rule {r.name} reads {x.state}, which no rule writes")
                needs[r.name] |= writers[x.state]
        phases: list[list[str]] = []
        left = dict(needs)
        while left:
            ready = [n for n, need in left.items() if not need & left.keys()]
            if not ready:
                raise ProgramError(f"cyclic dependencies among {sorted(left)}")
            phases.append(ready)
            for n in ready:
                del left[n]
        return phases

    def run(self, tables: dict[str, DataFrame], ts: str = "ts") -> Replay:
        """``tables``: event tables by name, each with epoch milliseconds in ``ts``.

        The rows of a rule that reads states and that others go on from are written once, so that what follows, which
        uses them several times, starts from a table.
        """
        ledgers: dict[str, list[DataFrame]] = {}
        results: dict[str, DataFrame] = {}
        for phase in self.compile():
            made: dict[str, list[DataFrame]] = {}
            for name in phase:
                r = self.rules[name]
                rows = results[r.extends] if r.extends else tables[r.events]
                for i, (column, x) in enumerate(r.reads.items()):  # a read upon a read starts from a table
                    rows = self._read(rows, column, x, ledgers[x.state], ts, settle=i > 0)
                for column, expression in r.columns.items():
                    rows = rows.withColumn(column, expression)
                if r.reads and (r.writes or any(o.extends == name for o in self.rules.values())):
                    rows = st.settled(rows)
                results[name] = rows
                for w in r.writes:
                    s = self.states[w.state]
                    fired = rows if w.when is None else rows.where(w.when)
                    keys = [k.cast((d.split() + ["string"])[1]).alias(d.split()[0]) for k, d in zip(w.keys, s.keys)] or [F.lit(0).alias("__all")]
                    made.setdefault(w.state, []).append(fired.select(*keys, F.col(ts), (F.lit(1) if w.value is None else w.value).alias("v")))
            for k, v in made.items():
                ledgers.setdefault(k, []).extend(v)
        return Replay(self, results, {k: _union(v) for k, v in ledgers.items()}, ts)

    def _read(self, rows: DataFrame, column: str, x: Read, ledgers: list[DataFrame], ts: str, settle: bool) -> DataFrame:
        s, names = self.states[x.state], rows.columns
        keyed = rows.withColumns({f"__k{i}": k for i, k in enumerate(x.keys)} or {"__k0": F.lit(0)})
        ledger = _union(ledgers).withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(s.key_names)})
        keys = [f"__k{i}" for i in range(len(s.key_names))]
        out = st.asof_running(keyed, ledger, keys, {column: (s.fold, "v")}, ts, x.strict, s.width_ms, s.split_ms, settle=settle)
        value = F.col(column) if x.default is None else F.coalesce(F.col(column), F.lit(x.default))
        return out.select(*[n for n in names if n != column], value.alias(column))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@dataclass
class Replay:
    """Results of a run: each rule's rows, and the states."""

    program: Program
    rows: dict[str, DataFrame]
    ledgers: dict[str, DataFrame]
    ts: str

    def at(self, state: str, time: int | None = None) -> DataFrame:
        """A whole state as of a time, or as of the end with every limited update expired: (keys, value)."""
        s, rows = self.program.states[state], self.ledgers[state]
        if time is not None:
            rows = rows.where(F.col(self.ts) <= time)
        if s.width_ms is not None:
            rows = rows.where(F.col(self.ts) > time - s.width_ms) if time is not None else rows.where(F.lit(False))
        kind = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "avg": F.avg, "set": F.collect_set}[s.fold]
        keys = [] if s.key_names == ["__all"] else s.key_names
        return rows.groupBy(*keys).agg(kind("v").alias("value"))
