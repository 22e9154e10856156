"""Command line: ``python -m tidemark.sources.generate uniform|tunable USERS EVENTS PATH [options]``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import partition_of
from . import files, generators


def _write(rows: DataFrame, path: str, splits: int, by_key: bool, keep_only: int) -> None:
    """One table: as Spark lays it, or in ``splits`` parts, of which ``keep_only`` (if not negative) is all that is written."""
    if not splits:
        return files.write_events(rows, path)
    if keep_only >= 0:  # dealt by turns, an event's turn follows from its id
        part = partition_of(F.col("user_a"), splits) if by_key else F.pmod("id", F.lit(splits))
        return files.write_by_key(rows.where(part == keep_only), path, splits, "user_a") if by_key else files.write_round_robin(rows.where(part == keep_only), path, 1)
    return files.write_by_key(rows, path, splits, "user_a") if by_key else files.write_round_robin(rows, path, splits)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Write synthetic events as Parquet.")
    p.add_argument("kind", choices=["uniform", "tunable"])
    p.add_argument("users", type=int)
    p.add_argument("events", type=int)
    p.add_argument("path")
    p.add_argument("--splits", type=int, default=0, help="number of parts; 0 leaves files to Spark")
    p.add_argument("--keep-only", type=int, default=-1, help="the one part that is written; -1 for all")
    p.add_argument("--by-key", action="store_true", help="deal by the sender instead of by turns")
    p.add_argument("--batches", type=int, default=1, help="write PATH-0, PATH-1, ... of about equal numbers of events in order of time")
    p.add_argument("--alpha", type=float, default=2.0, help="exponent of the tunable source")
    p.add_argument("--seed", type=int, default=generators.SEED)
    a = p.parse_args(args)
    if a.keep_only >= max(1, a.splits):
        p.error("--keep-only must be less than --splits")
    spark = SparkSession.builder.getOrCreate()
    if a.kind == "uniform":
        made, per_draw = generators.uniform_events(spark, a.users, a.events, seed=a.seed), 1
    else:
        made, per_draw = generators.tunable_events(spark, a.users, a.events, a.alpha, seed=a.seed), generators.BURST
    if a.batches == 1:
        return _write(made, a.path, a.splits, a.by_key, a.keep_only)
    size = -(-a.events // a.batches)
    for i in range(a.batches):  # ids follow time; those of one draw's burst are together
        draw = F.floor(F.col("id") / per_draw)
        _write(made.where((draw >= i * size) & (draw < (i + 1) * size)), f"{a.path}-{i}", a.splits, a.by_key, a.keep_only)


if __name__ == "__main__":
    main()
