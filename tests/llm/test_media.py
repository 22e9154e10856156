import hashlib
import zipfile
import zlib

import numpy as np
import pytest

from tidemark.llm import common, media

TEXTS = [(1, "a" * 64), (2, "b" * 65), (3, ""), (4, None), (5, "ends with zeros\0\0"), (6, "日本" * 5000), (7, "a" * 64), (None, "no id"), (7, "a" * 64)]


def test_round_trip(spark):
    docs = spark.createDataFrame([(*t, "clash") for t in TEXTS], "doc_id long, text string, media string").repartition(3)
    path = common.scratch_path(spark, "test-media")
    assert media.write_archives(docs, path, archive_bytes=200).count() > 3
    rows = media.describe(media.read_archives(spark, path, splitBytes=100, batchBytes=64)).collect()
    want = []
    for key, text in TEXTS:
        body = (text or "").encode()
        payload = body + b"\0" * (-len(body) % 64 or (0 if body else 64))
        want.append((key, len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    order = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted((tuple(r)[:5] for r in rows), key=order) == sorted(want, key=order)
    by_text = {}
    for r in rows:
        by_text.setdefault((r.payload_sha256, r.n_bytes), set()).add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by_text.values())


def test_damaged_member_is_retried_and_kept_apart(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * 50) for i in range(6)], "doc_id long, text string").coalesce(1)
    path = common.scratch_path(spark, "test-media")
    name = media.write_archives(docs, path).first().archive
    fs, folder = common.on_executors(path)
    file = f"{folder}/{name}"
    with zipfile.ZipFile(file) as z:
        at = z.infolist()[2].header_offset + 80
    with open(file, "r+b") as f:
        f.seek(at)
        f.write(b"\xff\xff\xff")
    rows = media.read_archives(spark, path, onError="keep", waitSeconds=0.01, attempts=3).collect()
    bad = [r for r in rows if r.error]
    assert len(rows) == 6 and len(bad) == 1 and bad[0].attempts == 3 and bad[0].media is None
    assert media.describe(media.read_archives(spark, path, onError="keep", waitSeconds=0.01)).count() == 5
    with pytest.raises(Exception):
        media.read_archives(spark, path, waitSeconds=0.01).collect()


def test_member_is_read_again_after_a_failure(tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("x.png", b"payload")
    info = zipfile.ZipFile(path).infolist()[0]
    reader = media.ArchiveReader({"path": f"file://{tmp_path}", "waitSeconds": "0"})

    class Broken:
        def seek(self, _):
            raise OSError("gone")

        def close(self):
            raise OSError("gone too")

    fs, _ = common.on_executors(f"file://{tmp_path}")
    body, tries, error, _ = reader.member(fs, Broken(), str(path), info.header_offset, info.compress_size, info.file_size, info.compress_type, info.CRC)
    assert (body, tries, error) == (b"payload", 2, None)


def test_opening_is_tried_again(spark, tmp_path):
    """A file that fails to open now and then is read whole; one that never opens is kept apart."""
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for i in range(5):
            z.writestr(f"{i}.png", b"payload %d" % i)
    real, _ = common.on_executors(f"file://{tmp_path}")

    class Flaky:
        opened = 0

        def __init__(self, good):
            self.good = good

        def open_input_file(self, path):
            Flaky.opened += 1
            if not self.good(Flaky.opened):
                raise OSError("not now")
            return real.open_input_file(path)

    reader = media.ArchiveReader({"path": f"file://{tmp_path}", "waitSeconds": "0", "onError": "keep"})
    part = reader.partitions()[0]
    members, tries, error = reader.directory(Flaky(lambda n: n % 3 == 0), part)
    assert (len(members), tries, error) == (5, 3, None)
    file = None
    for name, offset, *sizes in members:
        body, _, error, file = reader.member(Flaky(lambda n: n % 2 == 0), media._close(file), part.archive, offset, *sizes)
        assert error is None and body == b"payload " + name[:1].encode()
    assert reader.member(Flaky(lambda n: False), None, part.archive, 0, 1, 1, 0, 0)[0] is None
    (tmp_path / "b.zip").write_bytes(b"no archive at all")
    rows = media.read_archives(spark, f"file://{tmp_path}", onError="keep", waitSeconds=0.01, attempts=2, splitBytes=8).collect()
    assert [r.member for r in rows if r.error] == [None] and sum(r.error is None for r in rows) == 5


def test_features_and_digests_follow_the_stored_bytes(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["", "a" * 64, "bc" * 500, "é" * 33])], "doc_id long, text string")
    path = common.scratch_path(spark, "test-media")
    media.write_archives(docs, path)
    stored = {r.member: bytes(r.media) for r in media.read_archives(spark, path).collect()}
    for r in media.describe(media.read_archives(spark, path)).collect():
        (body,) = [v for k, v in stored.items() if k.endswith(f"-{r.doc_id}.png")]
        assert (r.media_bytes, r.media_sha256) == (len(body), hashlib.sha256(body).hexdigest())
        text = docs.where(f"doc_id = {r.doc_id}").first().text.encode()
        payload = text + b"\0" * (-len(text) % 64 or (0 if text else 64))
        rows = [payload[i : i + 64] for i in range(0, len(payload), 64)]
        mean, columns = sum(payload) / len(payload), [sum(x[i] for x in rows) for i in range(64)]
        spread = (sum(b * b for b in payload) / len(payload) - mean**2) ** 0.5
        bits = "".join("1" if c * 64 > sum(payload) else "0" for c in columns)
        assert r.feature == f"64x{len(rows)};mean={mean:.4f};spread={spread:.4f};columns={int(bits, 2):016x}"


def test_images_with_filters_decode():
    import struct

    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (10, 64)).astype(np.int64)
    raw, above = b"", np.zeros(64, np.int64)
    for y, row in enumerate(image):
        left, corner = np.concatenate([[0], row[:-1]]), np.concatenate([[0], above[:-1]])
        p = left + above - corner
        a, b, c = abs(p - left), abs(p - above), abs(p - corner)
        guess = [0 * row, left, above, (left + above) >> 1, np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))][y % 5]
        raw += bytes([y % 5]) + ((row - guess) & 255).astype(np.uint8).tobytes()
        above = row
    png = media._PNG + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 64, 10, 8, 0, 0, 0, 0)) + media._chunk(b"IDAT", zlib.compress(raw)) + media._chunk(b"IEND", b"")
    assert (media.decode_image(png)[0] == image).all()
    with pytest.raises(ValueError):
        media.decode_image(png[:40] + b"x" + png[41:])


def test_empty_table(spark):
    path = common.scratch_path(spark, "test-media")
    assert media.write_archives(spark.createDataFrame([], "doc_id long, text string"), path).collect() == []
    assert media.describe(media.read_archives(spark, path)).collect() == []
