"""Media columns: payloads kept as lossless grey images in zip archives, read back by a custom Spark data source.

Writing: every partition of the input becomes archives of stored (not deflated) members, one PNG a document, 64
samples wide. Reading: the data source lists the archives of a folder and plans byte ranges over them; a partition
opens its archive's own directory, takes the members whose headers start in its range and streams them through
Arrow in batches of bounded bytes. A member that cannot be read or fails its checksum is read again by its offset
on a newly opened file, without repeating any other member; opening, and reading the directory, are tried again alike.

Every attempt of a writing task has archive names of its own, and ``manifest.json``, written last, names those that
count; a folder without one is read whole.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zipfile
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import common

WIDTH = 64
_PNG = b"\x89PNG\r\n\x1a\n"
_MANIFEST = "manifest.json"
_SCHEMA = "archive string, member string, header_offset long, attempts int, media binary, error string"
_ARROW = pa.schema([("archive", pa.string()), ("member", pa.string()), ("header_offset", pa.int64()), ("attempts", pa.int32()), ("media", pa.binary()), ("error", pa.string())])


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def pad(text: bytes) -> bytes:
    """Bytes 0 appended up to a positive multiple of the width."""
    return text.ljust(max(WIDTH, -(-len(text) // WIDTH) * WIDTH), b"\0")


def encode_image(payload: bytes, n_bytes: int) -> bytes:
    """An 8-bit grey PNG of rows of 64 samples; the unpadded length is kept in a text chunk."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.hstack([np.zeros((len(rows), 1), np.uint8), rows]).tobytes()
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"n_bytes\0%d" % n_bytes) + _chunk(b"IDAT", zlib.compress(raw, 6)) + _chunk(b"IEND", b"")


def decode_image(media: bytes) -> tuple[np.ndarray, int | None]:
    """(samples as height x width, unpadded length if kept) of an 8-bit grey PNG without interlacing.

    All five row filters are understood; other images, and damaged ones, raise ValueError.
    """
    if not media.startswith(_PNG):
        raise ValueError("not a PNG")
    at, packed, n_bytes, head = 8, [], None, None
    while at + 12 <= len(media):
        n, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + n]
        if len(body) != n or struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"tEXt" and body.startswith(b"n_bytes\0"):
            n_bytes = int(body[8:])
        at += 12 + n
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey image")
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(head[1], head[0] + 1)
    filters, rows = rows[:, 0], rows[:, 1:]
    if not filters.any():
        return rows, n_bytes
    out, above = np.zeros(rows.shape, np.int64), np.zeros(head[0], np.int64)
    for y, kind in enumerate(filters):
        row = rows[y].astype(np.int64)
        if kind == 1:
            row = np.cumsum(row)
        elif kind == 2:
            row = row + above
        elif kind:
            left = corner = 0
            for x in range(head[0]):
                up = int(above[x])
                if kind == 3:
                    guess = (left + up) >> 1
                else:
                    a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
                    guess = left if a <= b and a <= c else up if b <= c else corner
                corner, left = up, int(row[x] + guess) & 255
                row[x] = left
        out[y] = above = row & 255
    return out.astype(np.uint8), n_bytes


def features(samples: np.ndarray) -> str:
    """Shape, mean, spread and a 64-bit column hash of the samples; integer sums, so equal samples, equal text."""
    columns, n = samples.sum(0, dtype=np.int64), samples.size
    total = int(columns.sum())
    spread = max(0.0, float((np.bincount(samples.ravel(), minlength=256) * np.arange(256, dtype=np.int64) ** 2).sum()) / n - (total / n) ** 2) ** 0.5
    bits = np.packbits(columns * samples.shape[1] > total).tobytes().hex()
    return f"{samples.shape[1]}x{samples.shape[0]};mean={total / n:.4f};spread={spread:.4f};columns={bits}"


def write_archives(docs: DataFrame, path: str, archive_bytes: int = 128 << 20) -> DataFrame:
    """Write ``docs`` (doc_id, text) as archives under ``path``; returns (archive, n_members, bytes) once all are there.

    Null texts count as empty; rows may repeat, and null ids are written as ``null``; a text of any length is one
    member; other columns are ignored; an empty table gives no archive.
    """

    def write(batches):
        from pyspark import TaskContext

        fs, folder = common.on_executors(path)
        fs.create_dir(folder)
        part, done, out, zipped, size, count = TaskContext.get().partitionId(), [], None, None, 0, 0

        def close():
            zipped.close()
            out.close()
            done.append({"archive": name, "n_members": count, "bytes": size})

        for batch in batches:
            for key, text in zip(*(c.to_pylist() for c in batch.columns)):
                if zipped is None:
                    name = f"part-{part:06d}-{len(done):04d}-{uuid.uuid4().hex}.zip"
                    out = fs.open_output_stream(f"{folder}/{name}")
                    zipped, size, count = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True), 0, 0
                media = encode_image(pad(text), len(text))
                zipped.writestr(zipfile.ZipInfo(f"{count:08d}-{'null' if key is None else key}.png"), media)
                size, count = size + len(media), count + 1
                if size >= archive_bytes:
                    close()
                    zipped = None
        if zipped is not None:
            close()
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("archive", pa.string()), ("n_members", pa.int64()), ("bytes", pa.int64())]))

    body = docs.select(F.col("doc_id").cast("long").alias("key"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))
    spark = docs.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)
    written = sorted(body.mapInArrow(write, "archive string, n_members long, bytes long").collect())
    fs, folder = common.on_executors(path)
    with fs.open_output_stream(f"{folder}/{_MANIFEST}") as f:
        f.write(json.dumps([r.archive for r in written]).encode())
    return spark.createDataFrame(written, "archive string, n_members long, bytes long")


@dataclass
class ByteRange(InputPartition):
    archive: str
    start: int
    end: int


#: What a second attempt may mend.
_FAULTS = (OSError, ValueError, zlib.error, struct.error)


def _close(file) -> None:
    try:
        if file is not None:
            file.close()
    except _FAULTS:
        pass


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.split = int(options.get("splitBytes", 32 << 20))
        self.batch = int(options.get("batchBytes", 4 << 20))
        self.attempts = int(options.get("attempts", 4))
        self.wait = float(options.get("waitSeconds", 0.2))
        self.keep = options.get("onError", "fail").lower() == "keep"

    def partitions(self):
        from pyarrow.fs import FileSelector

        fs, folder = common.on_executors(self.path)
        if fs.get_file_info(f"{folder}/{_MANIFEST}").type.name == "File":
            with fs.open_input_stream(f"{folder}/{_MANIFEST}") as f:
                infos = fs.get_file_info([f"{folder}/{name}" for name in json.loads(f.read())])
        else:
            infos = [i for i in fs.get_file_info(FileSelector(folder, allow_not_found=True)) if i.path.endswith(".zip")]
        found = sorted((i.path, i.size) for i in infos)
        return [ByteRange(p, a, min(a + self.split, n)) for p, n in found for a in range(0, n, self.split)] or [ByteRange("", 0, 0)]

    def read(self, partition):
        if not partition.archive:
            return
        fs, _ = common.on_executors(self.path)
        members, tries, error = self.directory(fs, partition)
        rows, size, file = [], 0, None
        if error:
            if not self.keep:
                raise OSError(f"{partition.archive}: {error}")
            if partition.start == 0:  # once for the archive
                rows.append((partition.archive, None, None, tries, None, error))
        try:
            for name, offset, *sizes in sorted(members, key=lambda m: m[1]):
                media, tries, error, file = self.member(fs, file, partition.archive, offset, *sizes)
                if error and not self.keep:
                    raise OSError(f"{partition.archive} at {offset}: {error}")
                rows.append((partition.archive, name, offset, tries, media, error))
                size += len(media or b"")
                if size >= self.batch:
                    yield self.rows(rows)
                    rows, size = [], 0
            if rows:
                yield self.rows(rows)
        finally:
            _close(file)

    @staticmethod
    def rows(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    def pause(self, attempt):
        if attempt < self.attempts:
            time.sleep(self.wait * 2 ** (attempt - 1))

    def directory(self, fs, partition):
        """(members whose headers start in the range, attempts used, error or None) from the archive's own directory."""
        for attempt in range(1, self.attempts + 1):
            file = None
            try:
                file = fs.open_input_file(partition.archive)
                with zipfile.ZipFile(file) as directory:
                    return [(i.filename, i.header_offset, i.compress_size, i.file_size, i.compress_type, i.CRC) for i in directory.infolist() if partition.start <= i.header_offset < partition.end], attempt, None
            except (*_FAULTS, zipfile.BadZipFile, EOFError, NotImplementedError) as e:
                error = f"{type(e).__name__}: {e}"
                self.pause(attempt)
            finally:
                _close(file)
        return [], self.attempts, error

    def member(self, fs, file, archive, offset, packed, unpacked, kind, crc):
        """(bytes or None, attempts used, error or None, file to go on with or None) of the member at an offset."""
        for attempt in range(1, self.attempts + 1):
            try:
                if file is None:
                    file = fs.open_input_file(archive)
                file.seek(offset)
                head = file.read(30)
                if head[:4] != b"PK\x03\x04":
                    raise ValueError("no member header")
                file.seek(offset + 30 + sum(struct.unpack_from("<HH", head, 26)))
                body = file.read(packed)
                body = zlib.decompress(body, -15) if kind == zipfile.ZIP_DEFLATED else body
                if len(body) != unpacked or zlib.crc32(body) != crc:
                    raise ValueError("checksum differs")
                return body, attempt, None, file
            except _FAULTS as e:
                error, file = f"{type(e).__name__}: {e}", _close(file)
                self.pause(attempt)
        return None, self.attempts, error, None


class ArchiveSource(DataSource):
    """``spark.read.format("media_archives").load(folder)``: one row per member of the folder's zip archives.

    Options: ``splitBytes``, ``batchBytes``, ``attempts``, ``waitSeconds``, and ``onError``: ``fail`` (default) ends
    the task when a member cannot be read after all attempts, ``keep`` returns it with null media and its error, and
    an archive whose directory cannot be read as one such row without a member. An empty or missing folder has no rows.
    """

    @classmethod
    def name(cls):
        return "media_archives"

    def schema(self):
        return _SCHEMA

    def reader(self, schema):
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archives").options(**{k: str(v) for k, v in options.items()}).load(path)


def describe(members: DataFrame) -> DataFrame:
    """Payload digests and features of members read back; members without media are left out."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def digest(batches):
        for batch in batches:
            rows = []
            for name, media in zip(*(c.to_pylist() for c in batch.columns)):
                samples, n_bytes = decode_image(media)
                payload, key = samples.tobytes(), name.removesuffix(".png").partition("-")[2]
                rows.append((None if key == "null" else int(key), n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), features(samples)))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return members.where("media is not null").select("member", "media").mapInArrow(digest, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``, from the archives read back.

    Null and empty texts are 64 bytes 0; texts of any length are one image; repeated ids and rows, and null ids, have a
    row each, and equal texts equal values; other columns are ignored; an empty table has no rows.
    """
    path = common.scratch_path(spark, "media")
    write_archives(common.table(spark, sf_dir, "documents"), path)
    return describe(read_archives(spark, path))
