"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text.

Folding lower-cases, maps look-alike letters and digits put for letters to plain ones and drops invisible marks;
words then stand between single spaces, so an entry with a leading space is a word beginning and one with spaces
on both sides a word. Entries and their weights are learned: word beginnings and words whose share among toxic
documents is well above that among others, by log odds. Phrases of one or two words around a match that are
found among the others instead are exceptions, and matches inside them do not count. The sum of weights, alone and
against the text's length, goes through a logistic curve that is fitted on the same rows.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Labelled rows that are learned from, at most; chosen by a seeded hash of the id.
TRAIN_ROWS = 20_000
#: The shortest word beginning that is a candidate, and the documents that a candidate needs.
SHORTEST, LEAST_DOCS = 3, 4
#: Candidates that a task counts before it passes its counts on.
MOST_SEEN = 120_000
#: An entry's log odds and its log-likelihood ratio against chance are at least these.
LEAST_ODDS, LEAST_RATIO = 1.5, 25.0
PREDICT_AT = 0.3
_NAMES = ["matched", "density"]
#: Cyrillic, Greek and full-width letters that look like Latin ones, and digits used as letters.
_LOOKS = dict(zip("аеорсхуіѕјкмтнвԁɡԛԝαορεικντυχβ", "aeopcxyisjkmthbdgqwaopeikvtuxb")) | dict(zip("0134578", "oieastb"))
_TABLE = str.maketrans(_LOOKS | {chr(0xFF41 + i): chr(97 + i) for i in range(26)} | {c: "" for c in "­​‌‍⁠﻿"})
_WORDS = re.compile(r"[^\W\d_]+")
_SIGNS = re.compile(r"[@$](?=\w)")


def fold(text: str | None) -> str:
    """Words of a text, folded, each between single spaces; null and texts without letters give one space."""
    text = (text or "").lower()
    if "@" in text or "$" in text:
        text = _SIGNS.sub(lambda m: "a" if m[0] == "@" else "s", text)
    words = _WORDS.findall(text.translate(_TABLE))
    return f" {' '.join(words)} " if words else " "


@dataclass
class Lexicon:
    entries: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    curve: tuple[float, ...] = (-4.0, 0.0, 0.0)

    def key(self) -> str:
        return hashlib.sha256(repr((sorted(self.entries.items()), sorted(self.exceptions), self.curve)).encode()).hexdigest()


class Matcher:
    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.lexicon, self.automaton = lexicon, ahocorasick.Automaton()
        for text in {*lexicon.entries, *lexicon.exceptions}:
            self.automaton.add_word(text, (text, lexicon.entries.get(text), text in lexicon.exceptions))
        if len(self.automaton):
            self.automaton.make_automaton()

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the best entry at each start that no exception holds."""
        if not len(self.automaton):
            return []
        best: dict[int, tuple[float, int]] = {}
        spared = []
        for last, (text, weight, exception) in self.automaton.iter(folded):
            start = last + 1 - len(text)
            if exception:
                spared.append((start, last + 1))
            if weight is not None and (start not in best or weight > best[start][0]):
                best[start] = (weight, last + 1)
        found = [(a, b, w) for a, (w, b) in sorted(best.items())]
        if spared and found:
            spared.sort()
            kept, i, reach = [], 0, -1
            for a, b, w in found:
                while i < len(spared) and spared[i][0] <= a:
                    reach = max(reach, spared[i][1])
                    i += 1
                if b > reach:
                    kept.append((a, b, w))
            found = kept
        return found

    def features(self, folded: str) -> tuple[float, float]:
        """Logarithms of the matched weight and of it per hundred words."""
        total = sum(w for *_, w in self.matches(folded))
        return math.log1p(total), math.log1p(100 * total / (10 + folded.count(" ")))

    def score(self, text: str | None) -> float:
        first, *slopes = self.lexicon.curve
        z = first + sum(a * b for a, b in zip(slopes, self.features(fold(text))))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _count(sample: DataFrame, candidates) -> DataFrame:
    """(phrase, toxic, clean): documents of the sample in which each candidate is found, by label."""

    def count(batches):
        seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])

        def out():
            return pd.DataFrame([(k, *v) for k, v in seen.items()], columns=["phrase", "clean", "toxic"])

        for batch in batches:
            for text, y in zip(batch["text"], batch["y"]):
                for c in candidates(fold(text)):
                    seen[c][y] += 1
                if len(seen) > MOST_SEEN:
                    yield out()
                    seen.clear()
        yield out()

    parts = sample.select("text", "y").mapInPandas(count, "phrase string, clean long, toxic long")
    return parts.groupBy("phrase").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _sizes(longest: int):
    """Sizes of beginnings: each up to 8 letters, then ever wider apart, so a word of n letters has about log n of them."""
    n = SHORTEST
    while n <= longest:
        yield n
        n += 1 if n < 8 else max(2, n // 4)


def _beginnings(folded: str) -> set[str]:
    out = set()
    for w in set(folded.split()):
        out.update(f" {w[:n]}" for n in _sizes(len(w)))
        out.add(f" {w} ")
    return out


def _odds(toxic: float, clean: float, n_toxic: int, n_clean: int) -> float:
    return math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))


def choose(found: dict[str, tuple[int, int]], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Entries and their log odds from candidates (toxic and clean documents).

    A candidate gives way to a longer one that is found in nearly as many toxic documents, to longer ones without
    which it says little, and to a shorter one that says nearly as much.
    """
    longer: dict[str, list[str]] = defaultdict(list)
    sizes = sorted({len(p) for p in found})
    below = lambda p, there: (p[:k] for k in sizes[: bisect.bisect_left(sizes, len(p))] if p[:k] in there)
    for p in found:
        for q in below(p, found):
            longer[q].append(p)
    entries: dict[str, float] = {}
    for p in sorted(found, key=len):
        toxic, clean = found[p]
        odds = _odds(toxic, clean, n_toxic, n_clean)
        if any(found[q][0] >= 0.8 * toxic or _odds(toxic - found[q][0], max(0, clean - found[q][1]), n_toxic, n_clean) < LEAST_ODDS / 2 for q in longer[p]):
            continue
        shorter = [entries[q] for q in below(p, entries)]
        if not shorter or odds > max(shorter) + 0.7:
            entries[p] = odds
    return entries


def _one_of_each(sample: DataFrame) -> DataFrame:
    """One row for rows whose label and smallest hashed three-word shingle agree, so that copies count about once."""

    def shingle(texts: pd.Series) -> pd.Series:
        import xxhash

        out = []
        for t in texts:
            w = fold(t).encode().split()
            hashes = map(xxhash.xxh64_intdigest, map(b" ".join, zip(w, w[1:], w[2:])) if len(w) > 2 else [b" ".join(w)])
            out.append(min(hashes) - 2**63)
        return pd.Series(out, dtype="int64")

    keyed = sample.withColumn("shingle", F.pandas_udf(shingle, "long").asNondeterministic()(F.col("text")))
    return keyed.groupBy("shingle", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "y")


def _fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Logistic regression by Newton steps with a small ridge; first value is the intercept."""
    a, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
        w += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def learn(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> Lexicon:
    """The lexicon of at most ``limit`` labelled rows whose crc32(doc_id) mod 4 is not 2.

    Every candidate that passes the tests of documents, odds and ratio is weighed; the bounded sample is what bounds
    them. Null texts count as empty, equal and nearly equal ones about once. Without labels of both kinds (or rows) the
    lexicon is empty and every score is the same low value.
    """
    picked = common.labelled_sample(docs, labels, "toxic", common.split_of(F.col("doc_id"), 4) != 2, limit)
    whole, path = common.materialize(picked, "toxic-sample")
    sample, own_path = common.materialize(_one_of_each(whole), "toxic-kinds")
    kinds = {r.y: r.n for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(kinds) < 2:
        return Lexicon()
    odds = F.log((F.col("toxic") + 0.5) / (kinds[1] + 1)) - F.log((F.col("clean") + 0.5) / (kinds[0] + 1))
    total, hits = kinds[0] + kinds[1], F.col("toxic") + F.col("clean")
    part = lambda seen, of, n: F.when(seen > 0, seen * F.log(seen * total / (of * n))).otherwise(0.0)
    ratio = 2 * sum((part(F.col(c), hits, kinds[y]) + part(kinds[y] - F.col(c), total - hits, kinds[y]) for c, y in (("toxic", 1), ("clean", 0))), F.lit(0.0))
    strong = _count(sample, _beginnings).withColumn("odds", odds).where((F.col("toxic") >= LEAST_DOCS) & (F.col("odds") >= LEAST_ODDS) & (ratio >= LEAST_RATIO))
    found = {r.phrase: (r.toxic, r.clean) for r in strong.collect()}  # each in LEAST_DOCS of the sample's documents
    entries = choose(found, kinds[1], kinds[0])
    if entries:
        mild = _count(sample, _around(Lexicon(entries))).withColumn("odds", odds).where((F.col("clean") >= 3) & (F.col("odds") < -0.5))
        exceptions = frozenset(r.phrase for r in mild.select("phrase").collect())
    else:
        exceptions = frozenset()
    lexicon = Lexicon(entries, exceptions)
    rows = sample.select("y", _features(lexicon)(F.col("text")).alias("f")).select("y", "f.*").collect()  # TRAIN_ROWS rows of numbers
    rows.sort()
    for p in (path, own_path):
        common.delete_path(docs.sparkSession, p)
    return Lexicon(entries, exceptions, _fit_curve(np.array([r[1:] for r in rows]), np.array([r.y for r in rows], float)))


_matchers: dict[str, Matcher] = {}


def _matcher(lexicon: Lexicon) -> Matcher:
    if (key := lexicon.key()) not in _matchers:
        _matchers[key] = Matcher(lexicon)
    return _matchers[key]


def _around(lexicon: Lexicon):
    """Candidates for exceptions: the matched word, and it with the word before or after."""

    def around(folded: str) -> set[str]:
        out = set()
        for a, *_ in _matcher(lexicon).matches(folded):
            end = folded.index(" ", a + 1)
            after = folded.find(" ", end + 1)
            out.add(folded[a : end + 1])
            if a:
                out.add(folded[folded.rindex(" ", 0, a) : end + 1])
            if after > 0:
                out.add(folded[a : after + 1])
        return out

    return around


def _features(lexicon: Lexicon):
    kind = T.StructType([T.StructField(n, T.DoubleType()) for n in _NAMES])

    def features(texts: pd.Series) -> pd.DataFrame:
        m = _matcher(lexicon)
        return pd.DataFrame([m.features(fold(t)) for t in texts], columns=_NAMES)

    return F.pandas_udf(features, kind)


def score(text: Column, lexicon: Lexicon) -> Column:
    """double from 0 to 1; null and empty texts get the curve's value for no match."""

    def score(texts: pd.Series) -> pd.Series:
        m = _matcher(lexicon)
        return pd.Series([m.score(t) for t in texts], dtype=float)

    return F.pandas_udf(score, "double").asNondeterministic()(text)


def toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted. One pass, no shuffle.

    Null and empty texts have no match and score as such; texts of any length are matched whole; repeated ids and rows
    have a row each; a null id counts as the empty text in the split; other columns are ignored.
    """
    out = docs.select("doc_id", (common.split_of(F.col("doc_id"), 4) == 2).alias("held_out"), score(F.col("text"), lexicon).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= PREDICT_AT).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``toxicity`` of the whole of ``documents`` by a lexicon of its labelled rows; an empty table has no rows."""
    docs = common.table(spark, sf_dir, "documents")
    return toxicity(docs, learn(docs, common.table(spark, sf_dir, "labels")))
