"""Word queries over a table that is longer than their fixed probe times."""

from collections import Counter, defaultdict

import pytest

from tidemark.plans import QUERIES

IDS = [0, 1, 30, 31, 900, 901, 1234, 2000, 2345]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("words"))
    spark.createDataFrame([(i, f"the w{i} the w{i % 7}") for i in IDS], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


def test_the_last_probe_sees_every_document(spark, docs):
    out = {r.probe_ts: r.cnt for r in QUERIES["keyword_count_asof"](spark, docs).collect()}
    assert len(out) == 10 and max(out) == max(IDS)
    assert out == {p: sum(2 for i in IDS if i <= p) for p in out}
    assert out[max(IDS)] == 2 * len(IDS)


def test_every_document_is_in_a_window(spark, docs):
    want = defaultdict(Counter)
    for i in IDS:
        (probe,) = [p for p in range(0, 2_400_000, 30_000) if p - 30_000 < i * 1000 <= p]
        want[probe].update(["the", "the", f"w{i}", f"w{i % 7}"])
    rows = QUERIES["word_topk_sliding"](spark, docs).collect()
    assert {(r.probe_ts, r.word, r.cnt) for r in rows} == {(p, w, n) for p, c in want.items() for w, n in c.items()}
    assert sum(r.cnt for r in rows) == 4 * len(IDS)


def test_an_empty_table_has_no_probes(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("keyword_count_asof", "word_topk_sliding"):
        assert QUERIES[name](spark, str(tmp_path)).collect() == []
