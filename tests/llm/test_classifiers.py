import random
import zlib

import numpy as np
import pytest

from tidemark.llm import langid, quality, toxicity

EDGE = [(-1, None), (-2, ""), (-3, " \n"), (-4, "12 345 !!"), (-5, "x" * 50_000), (-6, "日本語"), (None, "no id"), (-7, "twice"), (-7, "twice")]


def split(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


def words(rng, syllables, n):
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n))


SYLLABLES = {"en": "th er on an re he in ed nd ha".split(), "fr": "ou é eau le que ai on ré".split(), "es": "os ción ar ue lla do ñ".split()}


@pytest.fixture(scope="module")
def corpus():
    rng, rows = random.Random(8), []
    for i in range(900):
        lang = rng.choice(list(SYLLABLES))
        text, toxic, good = words(rng, SYLLABLES[lang], rng.randint(20, 120)), int(rng.random() < 0.2), int(rng.random() < 0.8)
        parts = text.split()
        if toxic:
            for _ in range(3):
                parts.insert(rng.randrange(len(parts)), rng.choice(["grumbug", "GRUMBUG,", "gr0mpet", "zorkel"]))
        elif rng.random() < 0.12:
            parts.insert(rng.randrange(len(parts)), "zorkel valley")
        if not good:
            parts = [p.upper() + "!!" for p in parts] if rng.random() < 0.5 else [p + "$$$" for p in parts]
        rows.append((i, " ".join(parts), lang, toxic, good))
    return rows


@pytest.fixture(scope="module")
def tables(spark, corpus):
    docs = spark.createDataFrame([(i, t, l, "s", "clash", 1) for i, t, l, _, _ in corpus] + [(i, t, None, "s", "clash", 1) for i, t in EDGE], "doc_id long, text string, lang string, source string, score string, y int")
    labels = spark.createDataFrame([(i, q, x) for i, _, _, x, q in corpus] + [(3, None, None), (None, 1, 1), (5, 7, 7), (corpus[0][0], corpus[0][4], corpus[0][3])], "doc_id long, quality int, toxic int")
    return docs, labels


def test_toxicity(spark, tables, corpus):
    docs, labels = tables
    rows = toxicity.toxicity(docs, toxicity.learn(docs, labels)).collect()
    truth = {i: x for i, _, _, x, _ in corpus}
    assert len(rows) == len(corpus) + len(EDGE)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (split(r.doc_id, 4) == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert not any(r.predicted for r in rows if r.doc_id is None or r.doc_id < 0)


def test_folding_finds_disguises_and_exceptions_spare():
    lexicon = toxicity.Lexicon({" loser": 3.0, " scum ": 2.0}, frozenset([" loser board "]))
    m = toxicity.Matcher(lexicon)
    hits = lambda t: len(m.matches(toxicity.fold(t)))
    assert hits("You LOSER!") == hits("l0$er") == hits("lоsеr") == hits("ｌｏｓｅｒ") == hits("los​er") == 1
    assert hits("closer") == hits("scummy") == hits("") == hits(None) == 0
    assert hits("the loser board") == 0 and hits("loser board, loser") == 1
    text = "the loser scum loserish xloser scum"
    folded = toxicity.fold(text)
    brute = [(i, i + len(e), w) for e, w in lexicon.entries.items() for i in range(len(folded)) if folded.startswith(e, i)]
    assert m.matches(folded) == sorted(brute)


def test_quality(spark, tables, corpus):
    docs, labels = tables
    model = quality.learn(docs, labels)
    rows = quality.quality(docs, model).collect()
    truth = {i: q for i, _, _, _, q in corpus}
    assert len(rows) == len(corpus) + len(EDGE)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (split(r.doc_id, 5) == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_discriminant_is_the_difference_of_gaussian_densities():
    rng = np.random.default_rng(0)
    x, y = np.vstack([rng.normal(0, 1, (200, 3)), rng.normal(1, 2, (300, 3))]), np.repeat([0, 1], [200, 300])
    model = quality.fit(x, y)
    z = (x[:5] - model.centre) / model.scale
    want = []
    for k in (0, 1):
        cov = np.linalg.inv(model.inverses[k].T @ model.inverses[k])
        diff = z - model.means[k]
        want.append(-0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(model.evidence(x[:5]), want[1] - want[0])


def test_languages(spark, tables, corpus):
    docs, _ = tables
    rows = langid.languages(docs, langid.learn(docs)).collect()
    truth = {i: l for i, _, l, _, _ in corpus}
    assert len(rows) == len(corpus) + len(EDGE)
    assert all(0 <= r.score <= 1 and r.held_out == (split(r.doc_id, 4) == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    edge = {r.doc_id: r.lang_pred for r in rows if r.doc_id is not None and r.doc_id < 0}
    assert edge[-1] == edge[-2] == edge[-3] == edge[-4] == "und" and edge[-5] in SYLLABLES and edge[-6] in SYLLABLES


@pytest.fixture(scope="module")
def net():
    return langid._start(["a", "b", "c"], np.random.default_rng(1))


def test_gradients_equal_differences(net):
    rng = np.random.default_rng(2)
    windows = rng.integers(0, 256, (7, 5))
    windows[4:, 1] = windows[2:, 3] = langid.PAD
    y = rng.integers(0, 3, 5)
    for w in langid._weights(net):
        w[...] = w.astype(np.float32)
    _, grads = langid.gradients(net, windows, y)
    for k, w in enumerate(langid._weights(net)):
        spots = [(0, 0), tuple(s - 1 for s in w.shape)] if k > 1 else [(0, int(windows[0, 0])), (10, int(windows[1, 2])), (20, int(windows[3, 4]))]
        for s in spots:
            old, e = w[s], 1e-2
            w[s] = old + e
            up = langid.gradients(net, windows, y)[0]
            w[s] = old - e
            down = langid.gradients(net, windows, y)[0]
            w[s] = old
            assert abs((up - down) / (2 * e) - grads[k][s]) < 2e-3


def test_pooling_does_not_depend_on_company(net):
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (0, 1, 127, 128, 129, 1000, 5)]
    together = langid.pooled(net, texts)
    for t, row in zip(texts, together):
        assert np.allclose(langid.pooled(net, [t])[0], row, atol=1e-5)
        if t:
            assert abs(row.sum() - 1) < 1e-4
            p = [net.positions(np.frombuffer(t[i : i + langid.WINDOW], np.uint8).astype(np.intp)[:, None])[:, :, 0] for i in range(0, len(t), langid.WINDOW)]
            assert np.allclose(np.concatenate(p).mean(0), row, atol=1e-5)
    assert len(langid.label_positions(net, "é" * 100)) == 200 and langid.label_positions(net, "") == []


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(docs, toxicity.learn(docs, labels)).collect() == []
    assert quality.quality(docs, quality.learn(docs, labels)).collect() == []
    assert langid.languages(docs, langid.learn(docs)).collect() == []
    some = spark.createDataFrame([(1, "text"), (2, None)], "doc_id long, text string").selectExpr("*", "cast(null as string) lang")
    assert [r.lang_pred for r in langid.languages(some, langid.learn(some)).collect()] == ["und", "und"]
    assert [r.score for r in quality.quality(some, quality.learn(some, labels)).collect()] == [0.5, 0.5]
    assert [r.predicted for r in toxicity.toxicity(some, toxicity.learn(some, labels)).collect()] == [0, 0]


def test_repeated_rows_do_not_swell_the_sample(spark):
    from tidemark.llm import common

    docs = spark.createDataFrame([(1, "a")] * 50 + [(1, "b"), (2, None), (3, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 0), (3, None)], "doc_id long, toxic int")
    rows = common.labelled_sample(docs, labels, "toxic", labels.doc_id > 0, 10).collect()
    assert sorted((r.doc_id, r.y) for r in rows) == [(1, 1), (2, 0)]


def test_lexicon_follows_counts_of_every_candidate(spark):
    """Counts by brute force; entries pass the tests, and a strong candidate is left out for a better one alone."""
    import math
    import random

    import xxhash

    rng = random.Random(12)
    plain = ["".join(rng.choices("bdfgklmnprst", k=rng.randint(3, 9))) for _ in range(300)]
    ends = ["", "s", "ed", "ing", "ly", "ness"]
    rows, labels = [], []
    for i in range(600):
        toxic = rng.random() < 0.3
        words = rng.choices(plain, k=rng.randint(4, 20))
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["zorkelwhamification", "vexo", "crumbleguts"]) + rng.choice(ends))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, marks)
    kinds = {}
    for (i, text), (_, y) in zip(rows, labels):
        if split(i, 4) != 2:
            w = toxicity.fold(text).encode().split()
            kinds.setdefault((min(map(xxhash.xxh64_intdigest, (b" ".join(w[j : j + 3]) for j in range(len(w) - 2)))), y), text)
    n = [sum(y == k for _, y in kinds) for k in (0, 1)]
    found = {}
    for (_, y), text in kinds.items():
        for word in set(toxicity.fold(text).split()):
            for c in {f" {word} "} | {f" {word[:k]}" for k in (3, 4, 5, 6, 7, 8, 10, 12, 15, 18, 22) if k <= len(word)}:
                found.setdefault(c, set()).add((text, y))
    count = {c: (sum(y for _, y in s), sum(1 - y for _, y in s)) for c, s in found.items()}
    odds = {c: math.log((t + 0.5) / (n[1] + 1)) - math.log((f + 0.5) / (n[0] + 1)) for c, (t, f) in count.items()}
    assert lexicon.entries and all(count[e][0] >= toxicity.LEAST_DOCS and abs(odds[e] - w) < 1e-9 and w >= toxicity.LEAST_ODDS for e, w in lexicon.entries.items())
    for stem in ("zorkelwhamification", "vexo", "crumbleguts"):
        assert any(f" {stem}".startswith(e) for e in lexicon.entries)
    for e in lexicon.entries:
        assert not any(c != e and c.startswith(e) and c in lexicon.entries and count[c][0] >= 0.8 * count[e][0] for c in count)
    scores = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, lexicon).collect()}
    assert sum(scores[i] == y for i, y in labels) >= 0.97 * len(labels)
    long = spark.createDataFrame([(1, "vexo " + "clean " * 200_000), (2, "x" * 100_000 + " vexoing")], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity(long, lexicon).collect())
