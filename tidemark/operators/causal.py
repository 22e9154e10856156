"""Causal edges between state accesses, and critical paths through them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def causal_edges(writes: DataFrame, reads: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """(src_ts, dst_ts) of every write and read after an earlier write of the same cell.

    A cell's merges are applied when it is read: a write counts if a read at or after it follows, its edge comes
    from the write before it; a read's edge comes from the last write up to it, unless that is at its own time.
    """
    both = writes.select(*keys, ts, F.lit(1).alias("w")).unionByName(reads.select(*keys, ts, F.lit(0).alias("w"))).groupBy(*keys, ts).agg(F.max("w").alias("w"), F.min("w").alias("only"))
    past = W.partitionBy(*keys).orderBy(ts).rangeBetween(W.unboundedPreceding, -1)
    ahead = W.partitionBy(*keys).orderBy(ts).rangeBetween(0, W.unboundedFollowing)
    seen = both.select(*keys, ts, "w", F.max(F.when(F.col("w") == 1, F.col(ts))).over(past).alias("src"), F.max(F.when(F.col("only") == 0, F.col(ts))).over(ahead).alias("last_read"))
    edges = seen.where(F.col("src").isNotNull() & ((F.col("w") == 0) | F.col("last_read").isNotNull()))
    return edges.select(F.col("src").alias("src_ts"), F.col(ts).alias("dst_ts"))


def batch_edges(edges: DataFrame, start: int, interval_ms: int) -> DataFrame:
    """Distinct edges with the batch of their end; an edge that does not go forward is an error at run time."""
    forward = F.when(F.col("src_ts") >= F.col("dst_ts"), F.raise_error(F.lit("an edge must go forward in time"))).otherwise(F.lit(True))
    return edges.where(forward).distinct().withColumn("batch", F.floor((F.col("dst_ts") - start) / interval_ms))


def critical_paths(batched: DataFrame) -> DataFrame:
    """(batch, length, vertices): edges of the longest path, and vertices, of each batch's graph.

    Edges go forward in time, so one pass in order of their ends is enough. A batch is one task's work by nature;
    batches are cut small by their interval.
    """
    import pandas as pd

    def longest(group: pd.DataFrame) -> pd.DataFrame:
        length: dict[int, int] = {}
        for src, dst in group.sort_values(["dst_ts", "src_ts"])[["src_ts", "dst_ts"]].itertuples(index=False):
            length[dst] = max(length.get(dst, 0), length.setdefault(src, 0) + 1)
        return pd.DataFrame({"batch": [group["batch"].iloc[0]], "length": [max(length.values())], "vertices": [len(length)]})

    return batched.groupBy("batch").applyInPandas(longest, "batch long, length long, vertices long")


def end_points(edges: DataFrame) -> DataFrame:
    """(vertex, role): sources, which no edge enters, and sinks, which none leaves."""
    src, dst = edges.select(F.col("src_ts").alias("vertex")).distinct(), edges.select(F.col("dst_ts").alias("vertex")).distinct()
    return src.join(dst, "vertex", "left_anti").withColumn("role", F.lit("source")).unionByName(dst.join(src, "vertex", "left_anti").withColumn("role", F.lit("sink")))
