import gzip
import hashlib
import io
import struct
import wave
import zipfile
import zlib

from treeline.llm import media


def png():
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


GIF = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff\x2c\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02\x44\x01\x00\x3b"
BMP = b"BM" + struct.pack("<IIIIiiHHIIIIII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\0\0\0"
JPEG = b"\xff\xd8\xff\xe0\x00\x04AB\xff\xc0\x00\x0b\x08\x00\x01\x00\x01\x01\x01\x11\x00\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00\x12\xff\x00\x34\xff\xd9"
PDF = b"%PDF-1.4\nstuff startxref\n9\n%%EOF"
OGG = b"OggS\0\x06" + b"\0" * 8 + b"abcd" + b"\0" * 8 + b"\x01\x03xyz"


def zipped():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("a.txt", "hello")
    return b.getvalue()


FILES = {"image/png": png(), "image/gif": GIF, "image/bmp": BMP, "image/jpeg": JPEG, "application/pdf": PDF, "audio/ogg": OGG, "application/gzip": gzip.compress(b"hello" * 10), "application/zip": zipped(), "audio/wav": media.to_wav(b"abc" * 5)}


def test_every_format_is_found_with_its_exact_length():
    for mime, data in FILES.items():
        assert media.sniff(data)[0] == media.Found(mime, 0, len(data)), mime
        assert media.Found(mime, 7, len(data)) in media.sniff(b"7 bytes" + data + b"\0after"), mime


def test_damaged_and_chance_magic_is_refused():
    for mime, data in FILES.items():
        assert not [f for f in media.sniff(data[:-3]) if f.mime == mime], mime
    assert media.sniff(b"BM and RIFF and GIF89a and %PDF- and PK\x03\x04 are words \xff\xd8\xff" * 5) == []
    assert media.sniff(b"") == []
    assert media.feature(b"plain", "text/plain") == "text/plain>text/plain"


def test_declared_type_is_corrected_and_media_carved():
    data = media.to_wav(b"some " + FILES["image/png"] + b" more")
    assert media.feature(data, "image/jpeg") == f"image/jpeg>audio/wav;image/png@49+{len(FILES['image/png'])}"


def test_wave_is_readable_elsewhere():
    for n in (0, 1, 575, 576):
        with wave.open(io.BytesIO(media.to_wav(b"q" * n))) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.getnframes()) == (1, 1, n)
            assert w.readframes(n) == b"q" * n
        assert media.from_wav(media.to_wav(b"q" * n)) == b"q" * n


def test_query_against_its_definition(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "é😀"), (4, "x" * 576), (5, "x" * 577), (6, "y" * 2_000_000), (7, "same"), (7, "same"), (None, "same"), (8, "RIFF BM GIF89a \x00")]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_bytes", "'x' AS media", "2 AS id").write.parquet(str(tmp_path / "documents.parquet"))
    got = media.op8(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    want = []
    for i, t in rows:
        b = (t or "").encode()
        p = b + b"\xff" * ((-len(b)) % 576 or (0 if b else 576))
        m = media.to_wav(p)
        want.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), "application/octet-stream>audio/wav"))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert media.op8(spark, str(tmp_path)).count() == 0


def test_odd_media(spark):
    png = FILES["image/png"]
    rows = [(1, 0, None, None), (2, 0, "a/b", b""), (3, 3, "a/b", b"not a wave"), (4, 1, "a/b", media.to_wav(b"abcdef")[:-2]), (5, 1, "a/b", b"RIFF\0\0\0\0WAVE"), (6, 1, "a/b", media.to_wav(b"x" + png + png)), (6, 1, "a/b", media.to_wav(b"x" + png + png))]
    df = spark.createDataFrame(rows, "id long, n_bytes long, declared string, media binary").selectExpr("*", "'x' AS payload_bytes", "1 AS feature")
    got = sorted(((r.doc_id, r.payload_bytes, r.feature) for r in media.media_features(df).collect()))
    n = len(png)
    both = (6, 2 * n + 1, f"a/b>audio/wav;image/png@45+{n};image/png@{45 + n}+{n}")
    assert got == [(1, 0, "application/octet-stream>application/octet-stream"), (2, 0, "a/b>a/b"), (3, 10, "a/b>a/b"), (4, 4, "a/b>a/b"), (5, 12, "a/b>a/b"), both, both]
    carved = media.carve(df).collect()
    assert sorted((r.id, r.mime, r.start, bytes(r.data)) for r in carved) == sorted([(6, "image/png", 45, png), (6, "image/png", 45 + n, png)] * 2)


def test_many_entries_are_found_in_linear_time():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k in range(20_000):
            z.writestr(f"{k}.txt", "PK")
    data = b.getvalue()
    assert media.sniff(data) == [media.Found("application/zip", 0, len(data))]
    outer = io.BytesIO()
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("inner.zip", zipped())
    assert [x.start for x in media.sniff(outer.getvalue())][0] == 0 and len(media.sniff(outer.getvalue())) == 2
    assert media.sniff(b"PK\x03\x04" * 200_000) == []


def test_many_false_starts_in_linear_time():
    import time

    for piece in (b"\xff\xd8\xff\xe0", b"\xff\xd8\xff\xc0\x00\x02\xff\xda\x00\x02"):
        began = time.time()
        data = piece * 400_000
        assert all(media.jpeg(data, i) == 0 for i in range(0, len(data), len(piece)))
        assert time.time() - began < 10
