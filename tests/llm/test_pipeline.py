import random
from collections import Counter

import pytest

import corpus_pipeline as cp
from tidemark.llm import mix
from tests.llm.test_simhash import slow_components, slow_print

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    words = ["".join(rng.choices(["an", "er", "on", "th", "re"], k=3)) for _ in range(80)]
    rows, labels = [], []
    for i in range(400):
        text = " ".join(rng.choices(words, k=rng.randint(5, 60)))
        toxic = int(rng.random() < 0.2)
        if toxic:
            text += " grumbug and zorkel"
        if rng.random() < 0.1:
            text += " token=abcdefghijklmnop"
        rows.append((i, text, "en", rng.choice(["a", "a", "a", "b", None]), len(text)))
        labels.append((i, 1, toxic))
    for i in range(400, 460):
        rows.append((i, rows[i - 395][1].upper(), "en", "c", 1))
    rows += [(460, None, None, None, None), (461, "", "", "", 0), (461, "", "", "", 0), (None, "text without id", "en", "a", 15), (462, "same id", "en", "a", 7), (462, "other text of this id", "en", "b", 21)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows, {i for i, _, t in labels if t}


def test_stages_follow_brute_force(spark, folder):
    path, rows, toxic = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = cp.drop_toxic(spark, docs, path).cache()
    assert kept.columns == NAMES
    want = [r for r in rows if "grumbug" not in (r[1] or "").lower()]
    assert Counter(map(tuple, kept.collect())) == Counter(want)

    one = cp.drop_near_duplicates(spark, kept, path)
    got = [tuple(r) for r in one.collect()]
    prints = [slow_print(r[1]) for r in want]
    group = slow_components(list(range(len(want))), prints)
    low = {}
    for r, g in zip(want, group):
        key = (r[0] is None, r[0] or 0)
        low[g] = min(low.get(g, key), key)
    assert len(got) == len(low) and sorted((r[0] is None, r[0] or 0) for r in got) == sorted(low.values())
    assert set(got) <= set(want)

    masked = [tuple(r) for r in cp.mask_secrets(spark, spark.createDataFrame(got, docs.schema), path).collect()]
    assert not any("abcdefghijklmnop" in (r[1] or "") for r in masked) and any("[SECRET]" in (r[1] or "") for r in masked)
    for a, b in zip(sorted(got, key=str), sorted(masked, key=str)):
        assert a[0] == b[0] and (a == b or b[4] == len(b[1]))

    mixed = [tuple(r) for r in cp.mix_sources(spark, spark.createDataFrame(masked, docs.schema), path).collect()]
    assert set(mixed) <= set(masked) and max(Counter(mixed).values()) <= 3
    sizes, taken = Counter(), Counter()
    for r in masked:
        sizes[r[3]] += len((r[1] or "").split())
    for r in mixed:
        taken[r[3]] += len((r[1] or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    for s, t in zip(order, mix.water_fill([sizes[s] for s in order], [[1, 2, 3][i % 3] for i in range(len(order))], sum(sizes.values()), 3)):
        assert abs(taken[s] - float(t)) <= max(5, 0.02 * float(t))


def test_run_encodes_what_is_left(spark, folder):
    import hashlib

    path, rows, _ = folder
    out = cp.run(spark, path).collect()
    texts = {r[0]: r[1] or "" for r in rows}
    assert out and all(r.n_tokens == len(r.ids) for r in out)
    for r in out:
        if r.doc_id not in (None, 462) and "token=" not in texts[r.doc_id]:
            assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_extra_columns_and_long_texts_come_through(spark, tmp_path):
    """Columns named like the stages' own, in other cases, with dots and maps; a text of a megabyte."""
    extra = "Toxicity string, Copy int, COPIES int, Row_Hash string, masked int, `a.b` string, `x``y` int, tags map<string,int>, fp int, root int, N string"
    long = "long words of a text " * 50_000
    rows = [(i, t, "en", "ab"[i % 2], len(t or ""), "keep", i, 7, "h", 8, "dot", 9, {"k": i}, 1, 2, "n") for i, t in enumerate([long, None, "", "token=abcdefghijklmnop x y", "some other words", "yet another set of words here", "more of it than before"])]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 1, 0), (6, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        for r in out.collect():
            d = r.asDict()
            assert (d["Toxicity"], d["Copy"], d["Row_Hash"], d["a.b"], d["x`y"], d["tags"]) == ("keep", d["doc_id"], "h", "dot", 9, {"k": d["doc_id"]})
    out = {r.doc_id: r for r in cp.encode(spark, docs, str(tmp_path)).collect()}
    assert out[0].n_tokens == len(out[0].ids) > 100_000 and cp.run(spark, str(tmp_path)).count() > 0
