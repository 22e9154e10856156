"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Each distinct fingerprint is sent to its variants; fingerprints that meet on a variant are linked. For links at up
to three differing bits every fingerprint emits the variants within one bit, and those with an odd number of ones
also variants at two bits, both in the same half of the word. That is enough: fingerprints three bits apart differ
in parity, and of three positions two lie in one half, so the odd one reaches by those two what the even one
reaches by the third. Variants travel as packed bytes grouped by a hash bucket.

On a variant, one fingerprint within a single bit is the centre; everything else there is within three bits of it
and is linked to it alone. A group of m near copies so gives links in proportion to m, none is lost for the
components, and every link is verified. Components come from alternating large-star and small-star rounds, each
written to the shared folder.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RADIUS = 3
#: Variants in a bucket, about, and fingerprints whose variants are made at once; neither changes a result.
BUCKET_VARIANTS, AT_ONCE = 1_000_000, 2048
_ONE = np.uint64(1)
_SINGLE = [0] + [1 << i for i in range(64)]
_PAIRS = [1 << (h + i) | 1 << (h + j) for h in (0, 32) for i in range(32) for j in range(i)]
_MASKS = np.array(_SINGLE + _PAIRS, np.uint64)
_NEAR = len(_SINGLE)


def fingerprint_of(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash (unsigned) of a text's word shingles; see ``fingerprint``."""
    import xxhash

    w = text.lower().split()  # on bytes: A-Z alone, and ASCII white space alone
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[i:] for i in range(words))))
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[i : i + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, words: int = 3) -> Column:
    """long whose bits are the fingerprint: a bit is one if set in over half the XXH64 values of the shingles.

    A-Z are lower-cased, words are cut at ASCII white space, repeated shingles count each time; a text of fewer
    words is one shingle, one without words (or null) has fingerprint zero.
    """

    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(t or b"", words) for t in texts], np.uint64).view(np.int64))

    return F.pandas_udf(fingerprint, "long").asNondeterministic()(text.cast("binary"))


def _buckets(values: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (((values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def ball(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(variants, mask numbers) of fingerprints: variant ^ mask is the fingerprint again."""
    odd = (np.bitwise_count(fps) & 1).astype(bool)
    near, far = fps[:, None] ^ _MASKS[None, :_NEAR], fps[odd][:, None] ^ _MASKS[None, _NEAR:]
    codes = [np.tile(np.arange(_NEAR, dtype=np.uint16), len(fps)), np.tile(np.arange(_NEAR, len(_MASKS), dtype=np.uint16), int(odd.sum()))]
    return np.concatenate([near.ravel(), far.ravel()]), np.concatenate(codes)


def meet(variants: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links (fingerprint, smaller root) of the fingerprints that share variants; a forest of what is here."""
    order = np.argsort(variants, kind="stable")
    v, c = variants[order], codes[order]
    same = v[1:] == v[:-1]
    keep = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    v, c = v[keep], c[keep]
    if not len(v):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    fps = v ^ _MASKS[c]
    last = np.uint64(2**64 - 1)
    centres = np.minimum.reduceat(np.where(c < _NEAR, fps, last), starts)
    some = np.add.reduceat((c < _NEAR).astype(np.int64), starts) > 0
    sizes = np.diff(np.append(starts, len(v)))
    a, b = np.repeat(centres, sizes), fps
    linked = np.repeat(some, sizes) & (a != b) & (np.bitwise_count(a ^ b) <= RADIUS)
    return forest(a[linked], b[linked])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it reaches) of the nodes of some links that are not smallest themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def links(fps: DataFrame, count: int) -> DataFrame:
    """Links (a, b) among the distinct fingerprints of column ``fp``: enough to connect all within the radius."""
    n = max(1, -(-count * (_NEAR + len(_PAIRS) // 2) // BUCKET_VARIANTS))

    def emit(batches):
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for i in range(0, len(values), AT_ONCE):
                variants, codes = ball(values[i : i + AT_ONCE])
                bucket = _buckets(variants, n)
                order = np.argsort(bucket, kind="stable")
                variants, codes, bucket = variants[order], codes[order], bucket[order]
                cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                ends = np.append(cuts[1:], len(bucket))
                yield pa.record_batch([pa.array(bucket[cuts], pa.int64()), pa.array([variants[s:e].tobytes() for s, e in zip(cuts, ends)], pa.binary()), pa.array([codes[s:e].tobytes() for s, e in zip(cuts, ends)], pa.binary())], ["bucket", "variants", "codes"])

    def gather(group: pa.Table) -> pa.Table:
        variants = np.frombuffer(b"".join(group.column("variants").to_pylist()), np.uint64)
        codes = np.frombuffer(b"".join(group.column("codes").to_pylist()), np.uint16)
        a, b = meet(variants, codes)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return fps.select("fp").mapInArrow(emit, "bucket long, variants binary, codes binary").groupBy("bucket").applyInArrow(gather, "a long, b long")


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """((a, b), the folder that holds them): each node of the links that is not its component's smallest, with the smallest, by star rounds.

    Every round is written to the shared folder and the one before it deleted; nothing but counts reaches the
    driver. Self-links and repeated links do no harm.
    """
    spark = edges.sparkSession

    def large(e):
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))

    def small(e):
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        return e.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))

    def tidy(e):
        pair = e.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        return common.materialize(pair.groupBy("a", "b").agg(F.lit(1).alias("n")).select("a", "b"), "links")

    def state(e):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now, path = tidy(edges)
    before = state(now)
    while before[0]:
        half, half_path = tidy(large(now))
        new, new_path = tidy(small(half))
        common.delete_path(spark, path)
        common.delete_path(spark, half_path)
        now, path, after = new, new_path, state(new)
        if after == before:
            break
        before = after
    return now, path


def near_duplicates(docs: DataFrame, words: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, columns to carry, fp, root, component_id.

    component_id is the smallest non-null doc_id that links reach, itself included (null only if all there are
    null); root is the component's smallest fingerprint. Rows may repeat and share ids; texts without words have
    fingerprint zero and link like any other.
    """
    prints, _ = common.materialize(docs.select("doc_id", *carry, fingerprint(F.col("text"), words).alias("fp")), "fingerprints")
    nodes, nodes_path = common.materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    stars, stars_path = components(links(nodes, nodes.count()))
    members = stars.select(F.col("a").alias("fp"), F.col("b").alias("root")).unionByName(stars.groupBy("b").agg(F.lit(1).alias("n")).select(F.col("b").alias("fp"), F.col("b").alias("root")))
    members = members.join(nodes, "fp")
    roots = members.groupBy("root").agg(F.min("first_id").alias("component_id"))
    owners = members.join(roots, "root").select("fp", "root", "component_id")
    classes, _ = common.materialize(nodes.join(owners, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "first_id").alias("component_id")), "classes")
    for path in (nodes_path, stars_path):
        common.delete_path(docs.sparkSession, path)
    return prints.join(classes, "fp", "left").select("doc_id", *carry, "fp", "root", "component_id")


def one_of_each(docs: DataFrame, words: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns: of every component the row with the smallest doc_id.

    Null ids come last; among rows of one id the one with the smaller hash of all columns stays, and of equal rows
    one. Texts move once, to meet the hashes of the rows that stay.
    """
    h = common.free_name(docs, "row_hash")
    keyed = docs.withColumn(h, common.row_hash(docs))
    found = near_duplicates(keyed, words, (h,))
    stay = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", h)).alias("first")).select(F.col(f"first.{h}").alias(h)).distinct()
    return keyed.join(stay, h).dropDuplicates([h]).select(*(common.column(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``: doc_id, fingerprint, component_id.

    Null and empty texts have fingerprint zero; whole texts of any length count; repeated ids and rows have a row each;
    a component without any id has a null one; other columns are ignored; an empty table has no rows.
    """
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
