"""Token ids in raw binary shards with a minimal perfect hash from document keys to their place.

A folder holds pairs of files: ``.ids`` (the ids, little-endian, two or four bytes each, documents in ascending key
order) and ``.idx``: row offsets, keys, and a minimal perfect hash over the shard's distinct keys whose slots keep a
32-bit fingerprint and the key's first row. A key is found by its shard's key range, one hash probe, one fingerprint
comparison and one read. Null keys come first, in file order only; rows of equal key are adjacent, in the order of
their ids, and are found together, over shards too.

Documents are dealt to tasks by ranges of (key, hash of the text), and a task cuts what it gets, in order, into
shards of bounded documents and bytes. Every attempt of a task writes under names of its own; ``manifest.json``, which
is written last, names the files that count, so repeated and speculative attempts never touch a finished file.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words remembered by one worker, and the longest of them; beyond it the memory starts anew, which changes no result.
CACHE_ENTRIES, CACHE_BYTES = 600_000, 64
#: Documents dealt to one task, about, and most tasks; a task cuts its documents into as many shards as they need.
RANGE_DOCS, MOST_RANGES = 8192, 20_000
#: Id bytes of a shard, about.
SHARD_BYTES = 64 << 20
_READ = 8 << 20
#: ASCII signs that can follow a word; not the apostrophe, which may stay with it.
_SIGNS = rb"""!"#$%&()*+,-./:;<=>?@[\]^_`{|}~"""


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (the constants are splitmix64's) of keys under a seed."""
    with np.errstate(over="ignore"):
        x = keys + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash by cascaded bit arrays: a key sits at the first level where it is alone on its bit.

    About three to four bits a key; slots are the ranks of set bits. Keys that were never added may get any slot,
    which is why slots carry fingerprints.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, base = [], 0
        for words in levels:
            ones = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(base + np.cumsum(ones) - ones)
            base += int(ones.sum())
        self.size = base

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        left, levels = np.unique(keys.astype(np.uint64)), []
        while len(left):
            bits = max(64, -(-int(gamma * len(left)) // 64) * 64)
            at = _mix(left, len(levels)) % np.uint64(bits)
            alone = np.bincount(at.astype(np.int64), minlength=bits) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8").astype(np.uint64))
            left = left[~alone[at.astype(np.int64)]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where no level has it."""
        keys = np.asarray(keys).astype(np.uint64)
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (words, ranks) in enumerate(zip(self.levels, self.ranks)):
            if not len(left):
                break
            at = _mix(keys[left], level) % np.uint64(64 * len(words))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            has = (words[word] >> bit) & np.uint64(1) == 1
            below = words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[has]] = (ranks[word] + np.bitwise_count(below))[has]
            left = left[~has]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mix(np.asarray(keys).astype(np.uint64), 0x5EED) >> np.uint64(32)).astype(np.uint32)


class ShardWriter:
    """Streams documents, in ascending key order, into one shard under names of this attempt."""

    def __init__(self, fs, folder: str, part: int, number: int, dtype: str):
        self.fs, self.part, self.number, self.dtype = fs, part, number, np.dtype(dtype)
        self.name = f"shard-{part:05d}-{number:05d}-{uuid.uuid4().hex}"
        self.path, self.size = f"{folder}/{self.name}", 0
        self.out = fs.open_output_stream(f"{self.path}.ids")
        self.keys: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, key: int | None, ids: bytes) -> None:
        self.out.write(ids)
        self.size += len(ids)
        self.keys.append(key)
        self.lengths.append(len(ids) // self.dtype.itemsize)

    def close(self) -> dict:
        self.out.close()
        nulls = sum(k is None for k in self.keys)
        keys = np.array(self.keys[nulls:], np.int64)
        starts = np.concatenate([[0], np.cumsum(np.array(self.lengths, np.int64))]).astype("<i8")
        distinct, first = np.unique(keys, return_index=True)
        hashed = PerfectHash.build(distinct)
        slots = hashed.slots(distinct)
        prints, rows = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<i8")
        prints[slots], rows[slots] = fingerprints(distinct), first + nulls
        arrays = [starts, keys.astype("<i8"), prints, rows, *(w.astype("<u8") for w in hashed.levels)]
        head = json.dumps({"dtype": self.dtype.str, "nulls": nulls, "arrays": [[a.dtype.str, len(a)] for a in arrays]}).encode()
        with self.fs.open_output_stream(f"{self.path}.idx") as f:
            f.write(len(head).to_bytes(8, "little") + head)
            for a in arrays:
                f.write(a.tobytes())
        return {"part": self.part, "number": self.number, "name": self.name, "n_docs": len(self.keys), "n_ids": int(starts[-1]), "first_key": int(keys[0]) if len(keys) else None, "last_key": int(keys[-1]) if len(keys) else None}


class Shard:
    """One shard opened for keyed reads."""

    def __init__(self, fs, folder: str, name: str):
        name = f"{folder}/{name}"
        with fs.open_input_stream(f"{name}.idx") as f:
            raw = f.read()
        n = int.from_bytes(raw[:8], "little")
        head, at, arrays = json.loads(raw[8 : 8 + n]), 8 + n, []
        for kind, count in head["arrays"]:
            arrays.append(np.frombuffer(raw, kind, count, at))
            at += arrays[-1].nbytes
        self.starts, self.keys, self.prints, self.rows = arrays[:4]
        self.hashed, self.dtype, self.nulls = PerfectHash([a.astype(np.uint64) for a in arrays[4:]]), np.dtype(head["dtype"]), head["nulls"]
        self.file = fs.open_input_file(f"{name}.ids")

    def find(self, keys) -> np.ndarray:
        """The first row of each key by hash probe and fingerprint, -1 for keys that are not here."""
        keys = np.asarray(keys, np.int64)
        slots = self.hashed.slots(keys)
        if not self.hashed.size:
            return slots
        known = (slots >= 0) & (self.prints[slots] == fingerprints(keys))
        rows = np.where(known, self.rows[slots], -1)
        known &= self.keys[np.maximum(rows - self.nulls, 0)] == keys  # a fingerprint may agree by chance
        return np.where(known, rows, -1)

    def read(self, first: int, last: int) -> np.ndarray:
        """The ids of rows first to last, end exclusive, as one array."""
        a, b = (int(self.starts[i]) * self.dtype.itemsize for i in (first, last))
        self.file.seek(a)
        return np.frombuffer(self.file.read(b - a), self.dtype)

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of every document of this key."""
        row = int(self.find([key])[0])
        out = []
        while 0 <= row < len(self.starts) - 1 and self.keys[row - self.nulls] == key:
            out.append(self.read(row, row + 1))
            row += 1
        return out

    def scan(self):
        """(key, start within the shard, ids) of every row, null keys first and the rest by their keys' hash slots."""
        rows = np.arange(len(self.starts) - 1)
        if len(self.keys):
            firsts = self.find(self.keys)
            if (firsts < 0).any():
                raise ValueError("a key of this shard is missing from its index")
            new = np.concatenate([[True], self.keys[1:] != self.keys[:-1]])
            place = np.arange(len(self.keys))
            rows[self.nulls :] = firsts + place - np.maximum.accumulate(np.where(new, place, 0))
        i = 0
        while i < len(rows):
            j = i + 1
            while j < len(rows) and (self.starts[rows[j] + 1] - self.starts[rows[i]]) * self.dtype.itemsize <= _READ:
                j += 1
            ids, base = self.read(rows[i], rows[j - 1] + 1), int(self.starts[rows[i]])
            for k in range(i, j):
                a, b = int(self.starts[rows[k]]), int(self.starts[rows[k] + 1])
                yield (None if k < self.nulls else int(self.keys[k - self.nulls])), a, ids[a - base : b - base]
            i = j


class WordCodec:
    """A tokenizers encoder that may encode white-space separated words one by one and remember them.

    Ids are the library's own for ``encode(text, add_special_tokens=False)``: a text that holds the string of an added
    token is encoded whole. ``by_word`` is right for tokenizers whose normaliser never joins characters across white
    space and maps words of ASCII alone as it maps them in lower case, and whose pre-tokens are runs of letters, or
    runs of signs, without white space, mapped character by character; otherwise whole texts are encoded. A new word
    goes to the library's model directly if it is all letters (which characters are, and what each is mapped to, is
    asked of the library's pre-tokeniser once a character), else through its normaliser, pre-tokeniser and model in
    turn. Signs after a word are a word of their own.
    """

    def __init__(self, spec: str, dtype: str, by_word: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(spec)
        added = json.loads(spec).get("added_tokens") or []
        self.added = [t["content"].encode() for t in added]
        self.dtype, self.by_word = dtype, by_word and not any(t.get("normalized") for t in added)
        self.known: dict[bytes, bytes] = {}
        self.letters: dict[str, str | None] = {}
        if self.by_word:
            self.normal, self.split, self.merge = self.model.normalizer.normalize_str, self.model.pre_tokenizer.pre_tokenize_str, self.model.model.tokenize
            a_to_z = "thequickbrownfoxjumpsoverlazydog"
            self.plain = self.normal(a_to_z) == a_to_z and [p for p, _ in self.split(a_to_z)] == [a_to_z]

    def _letter(self, c: str) -> str | None:
        """What the pre-tokeniser maps a letter to; None for what is not part of a word."""
        if c not in self.letters:
            pieces = [p for p, _ in self.split(f"a{c}")]
            self.letters[c] = (pieces[0][1:] or None) if len(pieces) == 1 and pieces[0][:1] == "a" else None
        return self.letters[c]

    def _model(self, word: bytes) -> bytes:
        """The packed ids of a word; capitals of a word with other letters are left to the normaliser's own order."""
        if self.plain and word.isalpha():  # on bytes: a-z, as A-Z came in lower case
            ids = [t.id for t in self.merge(word.decode())]
        else:
            text = self.normal(word.decode())
            mapped = [self._letter(c) for c in text]
            pieces = [p for p, _ in self.split(text)] if None in mapped else ["".join(mapped)]
            ids = [t.id for p in pieces for t in self.merge(p)]
        return struct.pack(f"<{len(ids)}{'H' if self.dtype == '<u2' else 'I'}", *ids)

    def _word(self, word: bytes) -> bytes:
        if (found := self.known.get(word)) is None:
            low = word.lower() if word.isascii() else word
            if low is word or (found := self.known.get(low)) is None:
                found = self._model(low)
                if len(low) <= CACHE_BYTES:
                    self.known[low] = found
        return found

    def encode(self, text: bytes) -> bytes:
        if not self.by_word or any(t in text for t in self.added):
            return np.array(self.model.encode(text.decode(), add_special_tokens=False).ids, self.dtype).tobytes()
        if len(self.known) > CACHE_ENTRIES:
            self.known = {}
        words = (text.lower() if text.isascii() else text).split()  # on bytes: A-Z alone, and ASCII white space alone
        known, passing = self.known, []
        for w in set(words).difference(known):
            head = w.rstrip(_SIGNS)
            if head and len(head) < len(w) and head[-1:].isalpha():
                passing.append((w, self._word(head) + self._word(w[len(head) :])))
            else:
                ids = self._word(w)
                if w not in known:  # long ones, and capitals that stand for a known word
                    passing.append((w, ids))
        known.update(passing)
        out = b"".join(map(known.__getitem__, words))
        for w, _ in passing:  # made anew when they come again
            del known[w]
        return out


_codecs: dict[str, WordCodec] = {}


_MANIFEST = "part int, number int, name string, n_docs long, n_ids long, first_key long, last_key long"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, by_word: bool = False, docs_per_range: int = RANGE_DOCS, docs_per_shard: int = 1 << 16) -> list[dict]:
    """Encode ``docs`` (doc_id, text) with a tokenizers file and write shards under ``path``; returns their manifest.

    Reading the manifest's shards in order is ascending key order: null keys first, rows of equal key by the hash of
    their texts and then by their ids. A key that many rows share is dealt by that hash, so it is several tasks'
    work. ``end_id`` is appended to each document. Null and empty texts have no other ids; a text of any length is
    encoded whole; other columns are ignored. An empty table gives no shards.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("key"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))
    total, nulls, low = docs.agg(F.count(F.lit(1)), F.count(F.when(F.col("key").isNull(), 1)), F.min("key")).first()
    if not total:
        return []
    n = min(MOST_RANGES, -(-total // docs_per_range))
    keyed = max(1, round(n * (total - nulls) / total))
    cuts = docs.agg(F.percentile_approx("key", [i / keyed for i in range(1, keyed)], max(10_000, 10 * keyed))).first()[0] if keyed > 1 and low is not None else []
    bounds, shares = np.unique(np.array(cuts or [], np.int64), return_counts=True)
    null_shares = max(1, n - keyed)
    # A range ends with its bound; a key that is the bound of several ranges has that many of its own.
    own = np.where(shares > 1, shares, 0)
    firsts = np.concatenate([[0], np.cumsum(1 + own)]) + null_shares
    parts = int(firsts[-1]) + 1
    with open(tokenizer) as f:
        spec = f.read()
    from tokenizers import Tokenizer

    size = max(Tokenizer.from_str(spec).get_vocab_size(with_added_tokens=True), (end_id or 0) + 1)
    dtype = "<u2" if size <= 1 << 16 else "<u4"
    key = hashlib.sha256(f"{by_word}{spec}".encode()).hexdigest()
    spec, tail = spark.sparkContext.broadcast(spec), b"" if end_id is None else np.array([end_id], dtype).tobytes()

    def part_of(keys: np.ndarray, hashes: np.ndarray, null: np.ndarray) -> np.ndarray:
        """Numbers of ranges, ascending with (key, hash): null keys first, hot keys in as many ranges as they need."""
        share, at = hashes.astype(np.float64) / 2.0**64, np.searchsorted(bounds, keys, side="left")
        part, mine = firsts[at], np.append(own, 0)[at]
        hot = mine > 0
        hot[hot] = bounds[at[hot]] == keys[hot]
        part[hot] += 1 + np.minimum((share * mine).astype(np.int64), mine - 1)[hot]
        part[null] = np.minimum((share[null] * null_shares).astype(np.int64), null_shares - 1)
        return part

    def encode(batches):
        import xxhash

        if (codec := _codecs.get(key)) is None:
            codec = _codecs[key] = WordCodec(spec.value, dtype, by_word)
        for batch in batches:
            keys, ids, hashes = batch.column(0), [], np.zeros(batch.num_rows, np.uint64)
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                hashes[i] = xxhash.xxh64_intdigest(text)
                ids.append(codec.encode(text) + tail)
            null = keys.is_null().to_numpy(zero_copy_only=False)
            part = part_of(keys.fill_null(0).to_numpy(zero_copy_only=False), hashes, null)
            yield pa.record_batch([pa.array(part, pa.int32()), keys, pa.array((hashes ^ np.uint64(1 << 63)).view(np.int64)), pa.array(ids, pa.binary())], ["part", "key", "hash", "ids"])

    def write(batches):
        fs, folder = common.on_executors(path)
        fs.create_dir(folder)
        done, out = [], None
        for batch in batches:
            for part, key, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                full = out is not None and (len(out.keys) >= docs_per_shard or out.size >= SHARD_BYTES)
                if out is None or out.part != part or full:
                    done += [out.close()] if out else []
                    out = ShardWriter(fs, folder, part, len(done), dtype)
                out.add(key, ids)
        done += [out.close()] if out else []
        kinds = [pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4]
        names = [c.split()[0] for c in _MANIFEST.split(", ")]
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema(list(zip(names, kinds))))

    encoded = docs.mapInArrow(encode, "part int, key long, hash long, ids binary")
    dealt = encoded.repartitionById(parts, "part").sortWithinPartitions("part", F.asc_nulls_first("key"), "hash", "ids")
    manifest = sorted((r.asDict() for r in dealt.mapInArrow(write, _MANIFEST).collect()), key=lambda r: (r["part"], r["number"]))
    fs, folder = common.on_executors(path)
    fs.create_dir(folder)
    with fs.open_output_stream(f"{folder}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read_manifest(path: str) -> list[dict]:
    fs, folder = common.on_executors(path)
    with fs.open_input_stream(f"{folder}/manifest.json") as f:
        return json.loads(f.read())


class TokenStore:
    """Keyed access to written shards from one process."""

    def __init__(self, path: str, manifest: list[dict] | None = None):
        self.fs, self.folder = common.on_executors(path)
        self.manifest = [m for m in (read_manifest(path) if manifest is None else manifest) if m["first_key"] is not None]
        self.last, self.open = [m["last_key"] for m in self.manifest], {}

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of every document of this key, from all shards that have it."""
        out = []
        for m in self.manifest[bisect.bisect_left(self.last, key) :]:
            if key < m["first_key"]:
                break
            if m["name"] not in self.open:
                self.open[m["name"]] = Shard(self.fs, self.folder, m["name"])
            out += self.open[m["name"]].get(key)
        return out


def read_token_files(spark: SparkSession, path: str, manifest: list[dict]) -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    rows, base = [], 0
    for i, m in enumerate(manifest):
        rows.append((i, m["name"], base))
        base += m["n_ids"]
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def read(batches):
        fs, folder = common.on_executors(path)
        for batch in batches:
            for name, first in zip(*(batch.column(i).to_pylist() for i in (1, 2))):
                got = [(key, first + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for key, at, ids in Shard(fs, folder, name).scan()]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*got)], names)

    shards = spark.createDataFrame(rows, "id int, name string, base long")
    return shards.repartitionById(max(1, min(len(rows), MOST_RANGES)), F.col("id") % max(1, min(len(rows), MOST_RANGES))).mapInArrow(read, ", ".join(f"{c} long" for c in names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``, read back from the files.

    Null and empty texts have the end id alone; null ids come first; repeated ids are in turn, by their texts' hashes;
    other columns are ignored; an empty table has no rows.
    """
    import public_tokenizers

    path = common.scratch_path(spark, "token-files")
    manifest = write_token_files(common.table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2, by_word=True)
    return read_token_files(spark, path, manifest)
