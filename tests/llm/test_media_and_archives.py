"""Exact round trips: progressive JPEG and WARC records in ZIP packages."""

import gzip
import hashlib
import io
import random
import struct
import zipfile
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from alarmlens.llm import progressive_jpeg as jpeg
from alarmlens.llm import warc_zip

# ---------------------------------------------------------------- media


def restored(payloads):
    files = jpeg.encode_payloads(payloads)
    return files, [jpeg.payload_of(i, c) for i, c, _ in jpeg.decoded(files)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=700), st.text(alphabet="abz `é~\x00", max_size=900).map(str.encode)), min_size=1, max_size=5))
def test_payloads_come_back(data):
    payloads = [jpeg.padded(x) for x in data]
    files, back = restored(payloads)
    assert back == payloads
    assert files == [jpeg.encode_payloads([p])[0] for p in payloads]  # whatever the neighbours


@pytest.mark.parametrize("fill", [b"\x60" * 4096, b"a" * 4096, bytes(range(256)) * 40, b"\x60" * 63 + b"a" + b"\x60" * 640 + b"b" * 64])
def test_long_runs(fill):
    assert restored([fill])[1] == [fill]


def dct(block):
    """Plain inverse transform of one 8 by 8 block."""
    out = np.zeros((8, 8))
    for y in range(8):
        for x in range(8):
            out[y, x] = sum(
                (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) / 4 * block[v, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)
            )
    return out


def test_inverse_transform_and_colours():
    rng = np.random.default_rng(1)
    payload = bytes((96 + rng.integers(-20, 20, 6 * 64)).astype(np.uint8))
    files = jpeg.encode_payloads([payload])
    (image, coefs, tensor), = list(jpeg.decoded(files))
    assert (image.width, image.height, tensor.shape) == (16, 16, (16, 16, 3))
    planes = []
    for k in range(6):
        natural = np.zeros(64)
        natural[jpeg.ZIGZAG] = coefs[k]
        planes.append(np.clip(np.round(dct(natural.reshape(8, 8)) + 128), 0, 255))
    luma = np.vstack([np.hstack(planes[:2]), np.hstack(planes[2:4])])
    cb, cr = (np.kron(p, np.ones((2, 2))) - 128 for p in planes[4:])
    want = np.stack([luma + 1.402 * cr, luma - 0.344136 * cb - 0.714136 * cr, luma + 1.772 * cb], axis=2)
    assert np.abs(np.clip(want, 0, 255) - tensor).max() <= 2


def bits_of(codes):
    text = "".join(codes)
    text += "1" * (-len(text) % 8)
    return bytes(int(text[k : k + 8], 2) for k in range(0, len(text), 8)).replace(b"\xff", b"\xff\x00")


def test_interleaved_scans_and_end_of_band_runs():
    """A hand-made file: two components in one DC scan, no restart markers, an end-of-band run over three blocks."""
    seg = lambda m, b: bytes([0xFF, m]) + struct.pack(">H", len(b) + 2) + b
    dc = bytes([0x00, 0, 2, 2, *[0] * 13, 0, 1, 2, 3])  # sizes 0..3 with codes 00 01 100 101
    ac = bytes([0x10, 0, 2, 2, *[0] * 13, 0x00, 0x01, 0x10, 0x11])  # EOB, (0,1), EOB run of 2 or 3, (1,1)
    frame = struct.pack(">BHHB", 8, 8, 32, 2) + bytes([7, 0x21, 0, 9, 0x11, 0])
    data = b"\xff\xd8" + seg(0xDB, bytes([0, *[2] * 64])) + seg(0xC2, frame) + seg(0xC4, dc) + seg(0xC4, ac)
    # MCUs: Y Y C, Y Y C; values 1, 3, -1 | 3, 3, 2
    data += seg(0xDA, bytes([2, 7, 0, 9, 0, 0, 0, 0])) + bits_of(["01", "1", "100", "10", "01", "0", "00", "00", "100", "11"])
    # Y alone: block 0 has 1 at place 2, then an end-of-band run over blocks 1 to 3
    data += seg(0xDA, bytes([1, 7, 0, 1, 63, 0])) + bits_of(["101", "1", "00", "100", "1"]) + b"\xff\xd9"
    (image, coefs, tensor), = list(jpeg.decoded([data]))
    assert (image.width, image.height, tensor.shape) == (32, 8, (8, 32, 3))
    assert coefs[:, 0].tolist() == [1, 3, 3, 3, -1, 2]
    assert coefs[0, 2] == 1 and np.count_nonzero(coefs[:, 1:]) == 1


def test_only_progressive_files():
    with pytest.raises(ValueError):
        jpeg.parse(b"not a file")
    frame = struct.pack(">BHHB", 8, 8, 8, 1) + bytes([1, 0x11, 0])
    with pytest.raises(ValueError):
        jpeg.parse(b"\xff\xd8\xff\xc0" + struct.pack(">H", len(frame) + 2) + frame + b"\xff\xd9")


def test_media_columns(spark):
    long = "é long text " * 9000
    rows = [(1, None), (2, ""), (3, "abc"), (4, "abc"), (None, long), (6, "x" * 64)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jpeg.media_features(df).collect()
    for (i, t), r in zip(sorted(rows, key=lambda x: x[0] or 0), sorted(got, key=lambda r: r.doc_id or 0)):
        data = (t or "").encode()
        payload = jpeg.padded(data)
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    by = {r.doc_id: r for r in got}
    assert (by[3].media_sha256, by[3].feature) == (by[4].media_sha256, by[4].feature)
    assert by[1].media_sha256 == by[2].media_sha256
    tensors = jpeg.with_tensors(df.select("doc_id", jpeg.stored(df.text).alias("media")).union(spark.createDataFrame([(9, None)], "doc_id long, media binary"))).collect()
    for r in tensors:
        assert (r.doc_id == 9) == (r.image.rgb is None)
        assert r.doc_id == 9 or len(r.image.rgb) == r.image.width * r.image.height * 3


# ---------------------------------------------------------------- archives


def pages(spark, rows, tmp_path):
    df = spark.createDataFrame([(i, u, h, "n", 1) for i, u, h in rows], "page_id long, url string, html string, digest string, _row int")
    df.write.mode("overwrite").parquet(str(tmp_path / "pages"))
    return spark.read.parquet(str(tmp_path / "pages"))


def test_warc_round_trip(spark, tmp_path):
    big, other = "<p>é</p>" * 200, "y" * 1000
    rows = [(1, "http://a/ b\r\n", big), (2, None, big), (9, "http://c", big), (4, "u", other), (5, "u", "z" * 999), (6, "u", "z" * 999), (7, "u", None), (8, "u", ""), (None, "u", big), (11, "u", other), (11, "u", other)]
    got = warc_zip.round_trip(pages(spark, rows, tmp_path)).collect()
    last = {big: 9, other: 11}
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = h in last and i != last[h]
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last[h] if again else None))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(want, key=key)
    assert {r.uri for r in got if r.page_id == 1} == {"http://a/%20b%0D%0A"}
    assert warc_zip.round_trip(pages(spark, [], tmp_path)).count() == 0


def test_warc_round_trip_of_any_url(spark, tmp_path):
    """Braces and line breaks other than newline are part of a URL, at its ends too."""
    urls = ["http://h/{id}", "{", "http://h/{\"offset\": 0}", "http://h/a\u0085b", "http://h/a\u2028b\u2029", "\u00a0http://h/\u3000", "http://h/c: d"]
    got = warc_zip.round_trip(pages(spark, [(k, u, f"<p>{k}</p>") for k, u in enumerate(urls)], tmp_path)).collect()
    assert {r.page_id: r.uri for r in got} == {k: u.replace(" ", "%20") for k, u in enumerate(urls)}
    assert {r.page_id: r.payload_digest for r in got} == {k: hashlib.sha1(f"<p>{k}</p>".encode()).hexdigest() for k in range(len(urls))}


def test_many_small_archives(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, f"http://h/{k}", "".join(rng.choice("abc <>\n") for _ in range(rng.randint(0, 5000)))) for k in range(300)]
    df = warc_zip.record_kinds(pages(spark, rows, tmp_path).select("page_id", "url", "html"))
    archives = warc_zip.write_archives(df, f"file://{tmp_path}/out", archive_bytes=20_000)
    assert archives.count() > 3
    got = {r.page_id: bytes(r.payload) for r in warc_zip.read_archives(archives, 3).collect()}
    assert got == {i: h.encode() for i, _, h in rows}


@pytest.mark.parametrize("zip64", [False, True])
def test_foreign_packages(zip64, monkeypatch):
    """A package with other members, a comment and, forced by small limits, ZIP64 records."""
    if zip64:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    records = [warc_zip.warc_record(k, f"u{k}", b"x" * k * 50, None) for k in range(4)]
    packed, lines, data = [], [], b""
    for r in records:
        member = gzip.compress(r)
        lines.append(f'key 2024 {{"offset": {len(data)}, "length": {len(member)}}}\n')
        packed.append(member)
        data += member
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("datapackage.json", "{}" * 80, zipfile.ZIP_DEFLATED)
        z.writestr(warc_zip.DATA, data)
        z.writestr(warc_zip.INDEX, "".join(lines))
        z.comment = b"a comment"
    raw = out.getvalue()
    reads = []

    def read(at, n):
        reads.append(n)
        return raw[at : at + n]

    got = list(warc_zip.records_of(read, len(raw)))
    assert [len(r["payload"]) for r in got] == [0, 50, 100, 150]
    with pytest.raises(ValueError):
        warc_zip.member_start(read, next(m for m in warc_zip.central_directory(read, len(raw)) if m.method))
    with pytest.raises(ValueError):
        warc_zip.central_directory(lambda a, n: b"0" * n, 500)
