"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into windows of ``WINDOW`` bytes. Over each window one gated recurrent layer runs forwards and one
backwards; every position gets a probability for each language from both states, and a document's probabilities
are the mean over all its positions. Training is back-propagation through time in numpy on the driver, on a
bounded sample of windows.
"""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Documents of each language and windows of each document that are learned from, at most.
TRAIN_DOCS, TRAIN_WINDOWS = 500, 4
MOST_LANGUAGES = 500
WINDOW, HIDDEN, EPOCHS, BATCH, RATE = 128, 8, 6, 256, 0.02
#: Windows that run side by side when predicting.
LANES = 1024
PAD = 256


def _take_gates(table: np.ndarray, at: np.ndarray, out: np.ndarray) -> np.ndarray:
    return np.take(table, at, axis=1, out=out, mode="clip")


def _step(table, recurrent, bias, at, h, inputs, hidden, cand):
    """One step of the gated unit for all lanes, in place; gates are reset, update and candidate rows.

    Tables hold half of the reset and update sums, since sigmoid(x) is (1 + tanh(x / 2)) / 2.
    """
    n = len(h)
    _take_gates(table, at, inputs)
    np.matmul(recurrent, h, out=hidden)
    gates = inputs[: 2 * n]
    gates += hidden[: 2 * n]
    np.tanh(gates, out=gates)
    gates *= 0.5
    gates += 0.5
    reset, keep, inner = inputs[:n], inputs[n : 2 * n], hidden[2 * n :]
    inner += bias
    np.multiply(reset, inner, out=cand)
    cand += inputs[2 * n :]
    np.tanh(cand, out=cand)
    h -= cand
    h *= keep
    h += cand


@dataclass
class Network:
    """Weights: for each direction a byte table (3H x 257), recurrent weights (3H x H) and candidate bias (H x 1);
    an output of C x 2H with its bias."""

    langs: list[str]
    tables: list[np.ndarray]
    recurrent: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def key(self) -> str:
        return hashlib.sha256(b"".join([repr(self.langs).encode(), *(a.tobytes() for a in (*self.tables, *self.recurrent, *self.biases, self.out, self.out_bias))])).hexdigest()

    def positions(self, windows: np.ndarray) -> np.ndarray:
        """Probabilities (window length x languages x lanes) of windows given as (length x lanes) of bytes or PAD."""
        length, lanes = windows.shape
        n = HIDDEN
        states = np.empty((length, 2 * n, lanes), np.float32)
        inputs, hidden, cand = np.empty((3 * n, lanes), np.float32), np.empty((3 * n, lanes), np.float32), np.empty((n, lanes), np.float32)
        padded = bool((windows[-1] == PAD).any())
        for d, order in enumerate((range(length), range(length - 1, -1, -1))):
            h = np.zeros((n, lanes), np.float32)
            for t in order:
                _step(self.tables[d], self.recurrent[d], self.biases[d], windows[t], h, inputs, hidden, cand)
                if padded and d:
                    h *= windows[t] != PAD  # the backward run begins at the text's end
                states[t, d * n : (d + 1) * n] = h
        logits = np.matmul(self.out, states)
        logits += self.out_bias
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits


def windows_of(text: bytes) -> np.ndarray:
    """(number of windows x WINDOW) of bytes, the last one filled up with PAD."""
    n = -(-len(text) // WINDOW)
    out = np.full(n * WINDOW, PAD, np.int16)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, WINDOW)


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """(texts x languages): mean over positions of each text; zeros for empty texts."""
    out = np.zeros((len(texts), len(net.langs)))
    waiting, size = [], 0

    def flush():
        own = np.concatenate([np.full(len(w), i) for i, w in waiting])
        rows = np.concatenate([w for _, w in waiting])
        ends = (rows != PAD).sum(1)
        order = np.argsort(-ends, kind="stable")
        for i in range(0, len(order), LANES):
            pick = order[i : i + LANES]
            longest = int(ends[pick[0]])
            block = np.ascontiguousarray(rows[pick, :longest].T).astype(np.intp)
            p = net.positions(block)
            if ends[pick[-1]] < longest:
                p *= (block != PAD)[:, None, :]
            np.add.at(out, own[pick], p.sum(0).T)

    for i, text in enumerate(texts):
        for at in range(0, len(text), 1 << 20):
            w = windows_of(text[at : at + (1 << 20)])
            waiting.append((i, w))
            size += len(w)
            if size >= 16 * LANES:
                flush()
                waiting, size = [], 0
    if waiting:
        flush()
    return out / np.maximum(np.array([len(t) for t in texts])[:, None], 1)


def label_positions(net: Network, text: str) -> list[str]:
    """The likeliest language at every byte of a text."""
    w = windows_of(text.encode())
    if not len(w):
        return []
    best = net.positions(np.ascontiguousarray(w.T).astype(np.intp)).argmax(1).T.reshape(-1)[: len(text.encode())]
    return [net.langs[i] for i in best]


def _start(langs: list[str], rng) -> Network:
    n, c = HIDDEN, len(langs)
    f = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
    return Network(langs, [f(3 * n, PAD + 1, s=0.3) for _ in "fb"], [f(3 * n, n, s=n**-0.5) for _ in "fb"], [np.zeros((n, 1), np.float32) for _ in "fb"], f(c, 2 * n, s=0.3), np.zeros((c, 1), np.float32))


def gradients(net: Network, windows: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss over all positions and its gradients, in the order of ``_weights``, through time."""
    length, lanes = windows.shape
    n, real = HIDDEN, (windows != PAD)
    keep_all = []
    states = np.zeros((length, 2 * n, lanes), np.float32)
    for d, order in enumerate((range(length), range(length - 1, -1, -1))):
        h, kept = np.zeros((n, lanes), np.float32), {}
        for t in order:
            before = h
            inputs, hidden = net.tables[d][:, windows[t]], net.recurrent[d] @ before
            gates = 0.5 + 0.5 * np.tanh(inputs[: 2 * n] + hidden[: 2 * n])
            inner = hidden[2 * n :] + net.biases[d]
            cand = np.tanh(inputs[2 * n :] + gates[:n] * inner)
            h = cand + gates[n:] * (before - cand)
            if d:
                h = h * real[t]
            kept[t] = (before, gates, inner, cand)
            states[t, d * n : (d + 1) * n] = h
        keep_all.append(kept)
    logits = np.matmul(net.out, states) + net.out_bias
    logits -= logits.max(1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(1, keepdims=True)
    total = max(1, int(real.sum()))
    right = np.take_along_axis(p, np.broadcast_to(y, (length, 1, lanes)), 1)[:, 0]
    loss = float(-(np.log(np.maximum(right, 1e-9)) * real).sum() / total)
    np.put_along_axis(p, np.broadcast_to(y, (length, 1, lanes)), (right - 1)[:, None], 1)
    p *= (real / np.float32(total))[:, None, :]
    g_out = np.einsum("tcb,thb->ch", p, states, optimize=True)
    g_bias = p.sum((0, 2))[:, None]
    back = np.matmul(net.out.T, p)
    grads = []
    for d, order in enumerate((range(length - 1, -1, -1), range(length))):
        g_rec, g_b, flow = np.zeros_like(net.recurrent[d]), np.zeros_like(net.biases[d]), np.zeros((n, lanes), np.float32)
        sums = np.empty((length, 3 * n, lanes), np.float32)
        for t in order:
            before, gates, inner, cand = keep_all[d][t]
            g = flow + back[t, d * n : (d + 1) * n]
            if d:
                g = g * real[t]
            reset, keep = gates[:n], gates[n:]
            g_keep = g * (before - cand) * keep * (1 - keep) * 2  # of half the gate's sum
            g_cand = g * (1 - keep) * (1 - cand * cand)
            g_reset = g_cand * inner * reset * (1 - reset) * 2
            g_hidden = np.concatenate([g_reset, g_keep, g_cand * reset])
            sums[t, : 2 * n], sums[t, 2 * n :] = g_hidden[: 2 * n], g_cand
            g_rec += g_hidden @ before.T
            g_b += g_hidden[2 * n :].sum(1, keepdims=True)
            flow = g * keep + net.recurrent[d].T @ g_hidden
        at, rows = windows.ravel(), np.ascontiguousarray(sums.transpose(1, 0, 2)).reshape(3 * n, -1)
        grads += [np.array([np.bincount(at, weights=r, minlength=PAD + 1) for r in rows]), g_rec, g_b]
    return loss, [grads[0], grads[3], grads[1], grads[4], grads[2], grads[5], g_out, g_bias]


def _weights(net: Network) -> list[np.ndarray]:
    return [*net.tables, *net.recurrent, *net.biases, net.out, net.out_bias]


def train(windows: list[bytes], langs: list[str], seed: int = 5) -> Network:
    """A network from windows of text with their languages; each language weighs alike by repeating its windows."""
    names = sorted(set(langs))
    rng, number = np.random.default_rng(seed), {x: i for i, x in enumerate(names)}
    net = _start(names, rng)
    rows = np.concatenate([windows_of(w[:WINDOW]) for w in windows]).astype(np.intp)
    y = np.array([number[x] for x in langs])
    each = max(np.bincount(y))
    pool = np.concatenate([np.resize(rng.permutation(np.flatnonzero(y == i)), each) for i in range(len(names))])
    first, second, step = [np.zeros(w.shape) for w in _weights(net)], [np.zeros(w.shape) for w in _weights(net)], 0
    steps = EPOCHS * -(-len(pool) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(pool)
        for i in range(0, len(order), BATCH):
            pick = order[i : i + BATCH]
            _, grads = gradients(net, np.ascontiguousarray(rows[pick].T), y[pick])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for w, g, m, v in zip(_weights(net), grads, first, second):
                g = g * min(1.0, 1.0 / max(norm, 1e-9))
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def learn(docs: DataFrame) -> Network | None:
    """A network from documents with a language whose crc32(doc_id) mod 4 is not 2; None where there are none.

    About ``TRAIN_DOCS`` documents of each language, by a seeded hash of the id, give ``TRAIN_WINDOWS`` windows
    each, cut on the executors at places that their text's hash chooses. Texts without letters are not learned from.
    """
    spark = docs.sparkSession
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (common.split_of(F.col("doc_id"), 4) != 2)).select("doc_id", "lang")
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return None
    share = spark.createDataFrame([(r.lang, min(1.0, TRAIN_DOCS / r.n)) for r in counts], "lang string, share double")
    unit = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    ids = known.join(F.broadcast(share), "lang").where(unit < F.col("share")).groupBy("doc_id").agg(F.min("lang").alias("y"))  # about MOST_LANGUAGES x TRAIN_DOCS ids

    def cut(batches):
        for batch in batches:
            rows = []
            for text, y in zip(batch["text"], batch["y"]):
                if text is None or not any(map(str.isalpha, text)):
                    continue
                text = text.encode()
                places = np.random.default_rng(int.from_bytes(hashlib.sha256(text).digest()[:8], "big")).permutation(-(-len(text) // WINDOW))[:TRAIN_WINDOWS]
                rows += [(y, text[p * WINDOW : (p + 1) * WINDOW]) for p in places]
            yield pd.DataFrame(rows, columns=["y", "w"])

    sample = common.one_text_each(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")).select("text", "y").mapInPandas(cut, "y string, w binary")
    rows = sorted((r.y, bytes(r.w)) for r in sample.collect())
    return train([w for _, w in rows], [y for y, _ in rows]) if rows else None


_KIND = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def predict(text: Column, net: Network | None) -> Column:
    """struct<lang_pred, score>; ``und`` and 0 where the text is null or has no letter, or nothing was learned."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")

    def predict(texts: pd.Series) -> pd.DataFrame:
        some = [t is not None and net is not None and any(map(str.isalpha, t)) for t in texts]
        p = pooled(net, [t.encode() if ok else b"" for t, ok in zip(texts, some)]) if any(some) else np.zeros((len(texts), 1))
        return pd.DataFrame({"lang_pred": [net.langs[i] if ok else "und" for i, ok in zip(p.argmax(1), some)], "score": np.where(some, np.clip(p.max(1), 0, 1), 0.0)})

    return F.pandas_udf(predict, _KIND).asNondeterministic()(text)


def languages(docs: DataFrame, net: Network | None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score. One pass, no shuffle.

    Null texts and those without a letter are ``und`` with score 0; every byte of a text of any length has its say;
    equal probabilities go to the language that sorts first; repeated ids and rows have a row each; a null id counts as
    the empty text in the split; other columns are ignored.
    """
    return docs.select("doc_id", (common.split_of(F.col("doc_id"), 4) == 2).alias("held_out"), predict(F.col("text"), net).alias("p")).select("doc_id", "held_out", "p.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``languages`` of the whole of ``documents`` by a network of its known ones; an empty table has no rows."""
    docs = common.table(spark, sf_dir, "documents")
    return languages(docs, learn(docs))
