import base64
import hashlib

import public_tokenizers as P
import pytest

from tidemark.llm import bpe

TEXTS = ["", None, "Hello  world's  42nd\n\n\ttest ", "naïve Ünïcode 日本語 🙂🙂", "a" * 20_000, " \n \n ", "<|endoftext|> x", "Ωmega nbsp line", "x", "x", "don't they'll I'VE"]


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_digest_equals_tiktoken(spark, reference):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string, ids int")
    rows = {r.doc_id: r for r in bpe.round_trip(docs, bpe.public_tokenizer(spark)).collect()}
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        ids = reference.encode_ordinary(t or "")
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_columns_round_trip(spark, reference):
    tok = bpe.public_tokenizer(spark)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    ids = docs.select("doc_id", tok.encode(docs.text).alias("ids"))
    rows = ids.select("doc_id", "ids", tok.decode(ids.ids).alias("back")).collect()
    for r in rows:
        assert r.ids == reference.encode_ordinary(TEXTS[r.doc_id] or "")
        assert bytes(r.back) == (TEXTS[r.doc_id] or "").encode()


def test_tiny_cache_changes_nothing(reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    codec = bpe.Codec(bpe.serialise_model(bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))), P.PATTERN)
    for t in TEXTS:
        ids, _ = codec.encode(t or "")
        assert ids.tolist() == reference.encode_ordinary(t or "")


def test_vocabulary_without_a_byte_is_refused():
    with pytest.raises(ValueError):
        bpe.serialise_model({b"a": 0})


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.round_trip(docs, bpe.public_tokenizer(spark)).collect() == []
