import random
import re

import numpy as np
import xxhash

from tidemark.llm import simhash


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(ids, prints):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [low.get(find(i)) for i in range(len(ids))]


def test_components_equal_brute_force(spark):
    rng = random.Random(4)
    words = ["w%d" % i for i in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(60)]
    near = []
    for t in texts[:40]:
        w = (t + " ").split() * 6
        for _ in range(4):
            v = list(w)
            v[rng.randrange(len(v))] = rng.choice(words)
            near.append(" ".join(v))
    texts += near + ["", None, " \n", "One", "one", "ONE two", "É É", "é É", texts[0], texts[0].upper(), "x " * 20_000]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)] + [(1, texts[5]), (None, texts[6]), (None, "alone without id")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, fp string")
    got = simhash.near_duplicates(docs).collect()
    prints = [slow_print(t) for _, t in rows]
    want = sorted(zip(([d if d is not None else -1 for d, _ in rows]), prints, [c if c is not None else -1 for c in slow_components([d for d, _ in rows], prints)]))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.fp & (2**64 - 1), r.component_id if r.component_id is not None else -1) for r in got) == want
    assert len({w[2] for w in want}) < len(want) - 100


def test_balls_meet_at_every_distance():
    rng = np.random.default_rng(2)
    for bits in range(5):
        for _ in range(60):
            a = int(rng.integers(0, 2**63)) * 2 + int(rng.integers(0, 2))
            b = a
            for i in rng.choice(64, bits, replace=False):
                b ^= 1 << int(i)
            linked = len(simhash.meet(*simhash.ball(np.unique(np.array([a, b], np.uint64))))[0])
            assert linked == (1 <= bits <= 3)


def test_long_chain_and_hot_centre(spark):
    chain = [(i + 1, i) for i in range(200)]
    random.Random(1).shuffle(chain)
    star = [(1000 + i, 1000) for i in range(1, 300)]
    edges = spark.createDataFrame(chain + star + [(5, 5), (1, 0)], "a long, b long").repartition(3)
    got = {(r.a, r.b) for r in simhash.components(edges)[0].collect()}
    assert got == {(i, 0) for i in range(1, 201)} | {(1000 + i, 1000) for i in range(1, 300)}


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_the_whole_table_equals_brute_force(spark):
    """Every link of the rule among all pairs of documents is kept, and no other."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    prints = [slow_print(t) for _, t in docs]
    want = {d: (f"{p:016x}", c) for (d, _), p, c in zip(docs, prints, slow_components([d for d, _ in docs], prints))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.query(spark, "/root/testdata/sf0.001").collect()} == want


def test_near_copies_link_as_far_as_the_rule_reaches(spark):
    """Planted copies with more and more words changed: those within three bits are caught, all of them, and no others."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(2000)]
    rows, pairs = [], []
    for i in range(60):
        text = rng.choices(words, k=400)
        copy = list(text)
        for at in rng.sample(range(400), i % 6):
            copy[at] = rng.choice(words)
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(copy))]
        pairs.append((2 * i, 2 * i + 1))
    group = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = {i: slow_print(t) for i, t in rows}
    caught = [(a, b) for a, b in pairs if group[a] == group[b]]
    assert caught == [(a, b) for a, b in pairs if (prints[a] ^ prints[b]).bit_count() <= 3]
    assert all(group[a] == group[b] for a, b in pairs[::6]) and len(caught) < len(pairs)
