"""Byte-level BPE through a sentencepiece model that is serialised straight from a rank vocabulary.

Every token's bytes become one character each (U+0100 + byte), a piece's score is its negative rank, and the
normaliser is the identity, so sentencepiece's merge order (best score first, then leftmost) is the rank order of
byte-level BPE. Texts are cut into pre-tokens by the vocabulary's pattern and each pre-token is encoded by itself;
decoding maps ids back to bytes by table.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Pre-tokens remembered by one worker, and the longest of them; beyond it the memory starts anew, which changes no result.
CACHE_ENTRIES, CACHE_CHARS = 300_000, 64
#: Documents whose results leave a task together.
AT_ONCE = 256
_BYTE_CHARS = "".join(chr(0x100 + b) for b in range(256))


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value) -> bytes:
    """One protobuf field: int or bool as varint, float as 32 bits, bytes with their length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(int(value))
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto whose piece i + 1 is the token of the i-th smallest rank; piece 0 is unknown.

    Field numbers are those of the public sentencepiece_model.proto. All 256 single bytes must be tokens, so that
    nothing is ever unknown.
    """
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"the vocabulary has no token for the bytes {missing[:8]}")
    normal, unknown, bpe = 1, 2, 2
    out = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        piece = token.decode("latin-1").translate(_BYTE_CHARS).encode()
        out.append(_field(1, _field(1, piece) + _field(2, -float(rank)) + _field(3, normal)))
    trainer = _field(3, bpe) + _field(4, len(ranks) + 1) + _field(40, 0) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    identity = _field(1, b"identity") + _field(2, b"") + _field(3, False) + _field(4, False) + _field(5, False)
    return b"".join(out) + _field(2, trainer) + _field(3, identity)


class Codec:
    """Encoder and decoder over one serialised model; lives in a worker and remembers pre-tokens."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(model)
        self.split = regex.compile(pattern).findall
        n = self.model.get_piece_size()
        back = {c: b for b, c in enumerate(_BYTE_CHARS)}
        tokens = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(1, n)]
        self.ranks = np.array([-self.model.get_score(i) for i in range(n)], np.float64).astype(np.int64)
        self.whole = {t: int(r) for t, r in zip(tokens, self.ranks[1:])}
        by_rank = [b""] * (int(self.ranks.max()) + 1)
        for t, r in self.whole.items():
            by_rank[r] = t
        self.lengths = np.array([len(t) for t in by_rank], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(by_rank), np.uint8)
        self.ids_of: dict[str, bytes] = {}
        self.digits_of: dict[str, str] = {}

    def _learn(self, pieces: set[str]) -> None:
        rest = []
        for p in pieces:
            rank = self.whole.get(p.encode())
            if rank is None:
                rest.append(p)
            else:
                self.ids_of[p], self.digits_of[p] = np.uint32(rank).tobytes(), str(rank)
        for p, found in zip(rest, self.model.encode([p.encode().decode("latin-1").translate(_BYTE_CHARS) for p in rest], num_threads=1)):
            ids = self.ranks[found]
            self.ids_of[p], self.digits_of[p] = ids.astype("<u4").tobytes(), " ".join(map(str, ids.tolist()))

    def encode(self, text: str) -> tuple[np.ndarray, str]:
        """The ids, and the same as decimal text joined by one space."""
        pieces = self.split(text)
        if len(self.ids_of) > CACHE_ENTRIES:
            self.ids_of, self.digits_of = {}, {}
        if new := set(pieces).difference(self.ids_of):
            self._learn(new)
        out = np.frombuffer(b"".join(map(self.ids_of.__getitem__, pieces)), "<u4"), " ".join(map(self.digits_of.__getitem__, pieces))
        for p in new:
            if len(p) > CACHE_CHARS:  # made anew when they come again
                del self.ids_of[p], self.digits_of[p]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids, np.int64)
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ids) or not ends[-1]:
            return b""
        return self.bytes[np.repeat(self.starts[ids] - ends + lengths, lengths) + np.arange(ends[-1])].tobytes()


_codecs: dict[str, Codec] = {}


def _codec(key: str, model, pattern: str) -> Codec:
    if key not in _codecs:
        _codecs[key] = Codec(model.value, pattern)
    return _codecs[key]


class Tokenizer:
    """Spark columns over a vocabulary: ``encode`` and ``decode``.

    Null texts count as empty; an empty text has no ids; ids outside the vocabulary are an error on decoding. The
    model (about a megabyte) is built on the driver and broadcast.
    """

    def __init__(self, spark: SparkSession, vocabulary: str, pattern: str):
        model = serialise_model(load_ranks(vocabulary))
        self.key = hashlib.sha256(model + pattern.encode()).hexdigest()
        self.model, self.pattern = spark.sparkContext.broadcast(model), pattern

    def encode(self, text: Column) -> Column:
        """array<int> of token ids."""
        key, model, pattern = self.key, self.model, self.pattern

        def encode(texts: pd.Series) -> pd.Series:
            codec = _codec(key, model, pattern)
            return pd.Series([codec.encode(t or "")[0].astype(np.int32) for t in texts], dtype=object)

        return F.pandas_udf(encode, "array<int>").asNondeterministic()(text)

    def decode(self, ids: Column) -> Column:
        """binary: the bytes that the ids stand for; null ids count as none."""
        key, model, pattern = self.key, self.model, self.pattern

        def decode(rows: pd.Series) -> pd.Series:
            codec = _codec(key, model, pattern)
            return pd.Series([codec.decode([] if r is None else r) for r in rows], dtype=object)

        return F.pandas_udf(decode, "binary").asNondeterministic()(ids)


def public_tokenizer(spark: SparkSession, name: str = "byte_bpe_50k.tiktoken") -> Tokenizer:
    import public_tokenizers

    return Tokenizer(spark, public_tokenizers.path(name), public_tokenizers.PATTERN)


def round_trip(docs: DataFrame, tokenizer: Tokenizer, carry: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """One row per document: columns to carry, n_tokens, ids_sha256, decoded_sha256[, ids array<int>].

    Texts are encoded, and the ids decoded again; null texts count as empty. One pass, no shuffle; rows may repeat.
    Results leave in small batches, so a task holds one batch of texts and little more.
    """
    key, model, pattern = tokenizer.key, tokenizer.model, tokenizer.pattern
    names = [*carry, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]

    def run(batches):
        codec = _codec(key, model, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part, rows = batch.slice(at, AT_ONCE), []
                for text in part.column(len(carry)).to_pylist():
                    ids, digits = codec.encode(text or "")
                    rows.append((len(ids), hashlib.sha256(digits.encode()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest(), *([ids.view(np.int32)] if with_ids else ())))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(carry)], *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names)

    schema = T.StructType([docs.schema[c] for c in carry] + [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    return docs.select(*carry, "text").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_tokens and the digests of the ids and of what they decode to.

    Null and empty texts have no ids; texts of any length are encoded whole; repeated ids and rows, and null ids, have a
    row each; other columns are ignored; an empty table has no rows.
    """
    return round_trip(common.table(spark, sf_dir, "documents"), public_tokenizer(spark))
