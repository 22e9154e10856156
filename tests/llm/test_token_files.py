import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import xxhash

from tidemark.llm import common, token_files

TEXTS = ["", None, "Hello  World's 42nd\n\n\ttest", "naïve Ünïcode 日本語 🙂", "a" * 30_000, " \n ", "<|endoftext|> x", "é ́a Σας", "non breaking space", "x", "x"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


def expected(rows, tokenizer):
    ids = {}
    for key, text in rows:
        ids.setdefault(key, []).append((xxhash.xxh64_intdigest((text or "").encode()), tokenizer.encode(text or "", add_special_tokens=False).ids + [2]))
    out, start = [], 0
    for key in sorted(ids, key=lambda k: (k is not None, k)):
        for _, one in sorted(ids[key]):
            out.append((key, start, len(one), zlib.crc32(np.array(one, "<u4").tobytes())))
            start += len(one)
    return out


@pytest.mark.parametrize("by_word", [True, False])
def test_files_hold_every_document(spark, tokenizer, by_word):
    rows = [(7 * i - 20, t) for i, t in enumerate(TEXTS)] + [(None, "no key"), (None, None), (8, "twice"), (8, "twice more"), (-(2**62), "far"), (2**62, "away")]
    docs = spark.createDataFrame([(*r, "clash", 0) for r in rows], "doc_id long, text string, shard string, ids int")
    path = common.scratch_path(spark, "test-ids")
    manifest = token_files.write_token_files(docs, path, P.path("word_bpe_49k.json"), end_id=2, by_word=by_word, docs_per_range=4, docs_per_shard=3)
    assert len(manifest) > 2 and manifest == token_files.read_manifest(path)
    got = sorted((tuple(r) for r in token_files.read_token_files(spark, path, manifest).collect()), key=lambda r: r[1])
    assert got == expected(rows, tokenizer)
    store = token_files.TokenStore(path, manifest)
    for key, text in rows:
        if key is not None and key != 8:
            want = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
            assert [x.tolist() for x in store.get(key)] == [want] * len(store.get(key)) and store.get(key)
    assert len(store.get(8)) == 3 and store.get(9) == [] and store.get(-(2**63)) == []


def test_a_hot_key_is_many_ranges(spark, tokenizer):
    """A third of the rows share an id and a third have none: they are dealt by their texts' hashes, in order."""
    rows = [(5, f"hot {i}") for i in range(60)] + [(None, f"null {i}") for i in range(60)] + [(i, f"text {i}") for i in range(-20, 40)]
    path = common.scratch_path(spark, "test-ids")
    manifest = token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), path, P.path("word_bpe_49k.json"), end_id=2, by_word=True, docs_per_range=6)
    assert max(m["n_docs"] for m in manifest) < 40
    got = sorted((tuple(r) for r in token_files.read_token_files(spark, path, manifest).collect()), key=lambda r: r[1])
    assert got == expected(rows, tokenizer)
    assert len(token_files.TokenStore(path).get(5)) == 61


def test_shards_end_at_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_BYTES", 1000)
    path = common.scratch_path(spark, "test-ids")
    docs = spark.createDataFrame([(i, "words " * 200) for i in range(30)], "doc_id long, text string").coalesce(1)
    manifest = token_files.write_token_files(docs, path, P.path("word_bpe_49k.json"), by_word=True)
    assert len(manifest) >= 10 and sum(m["n_docs"] for m in manifest) == 30


def test_ids_are_the_librarys():
    """Capitals with combining marks, added tokens' strings, final sigmas, odd white space: the ids of the library."""
    from tokenizers import Tokenizer

    with open(P.path("word_bpe_49k.json")) as f:
        spec = f.read()
    plain, codec = Tokenizer.from_str(spec), token_files.WordCodec(spec, "<u2", True)
    rng = random.Random(8)
    kinds = [
        list("abcTJHWYAKsSIiéÉßẞΣσςοΟИй가가ÅÅﬁ日٣²½\U0001f642İıǅ"),
        list("̸ְ̧̨̱̣́̈̌̊̇̀̄̂ͅ‍⃐"),
        list("'\"!?.,;:-_<>|[]=+*/\\\x00\x1c\x1f"),
        list(" \t\n\r\x0b\x0c\x85\xa0　  "),
        ["<|endoftext|>", "<|startoftext|>", "<|endoftext", "|endoftext|>", "'s", "'re", "'LL"],
    ]
    texts = ["".join(rng.choice(rng.choices(kinds, (50, 20, 12, 15, 3))[0]) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    for text in [*texts, "T̈", "J̌an", "H̱amza W̊ Y̊", "a <|endoftext|> b", "ΑΣ ΑΣ. Σ"]:
        want = plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(codec.encode(text.encode()), "<u2").tolist() == want, ascii(text)


def test_perfect_hash_is_minimal_and_perfect():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64))
    h = token_files.PerfectHash.build(keys)
    assert sorted(h.slots(keys)) == list(range(len(keys)))
    assert token_files.PerfectHash.build(keys[:0]).size == 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    path = common.scratch_path(spark, "test-ids")
    manifest = token_files.write_token_files(docs, path, P.path("word_bpe_49k.json"))
    assert manifest == [] and token_files.read_token_files(spark, path, manifest).collect() == []
