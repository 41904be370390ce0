"""Media columns: signature sniffing of stored bytes.

``sniff`` finds every magic number in a byte string with one Aho-Corasick pass, and a validator
for each format then checks structure and lengths, because magic bytes also occur by chance. What
starts at offset 0 corrects the declared type; whatever else passes is an embedded file, carved by
its exact offset and length; ``carve`` returns its bytes.

The query packs texts as 8-bit mono PCM in RIFF/WAVE: a header of 44 bytes, the payload bytes as
samples, and a padding byte if their number is odd.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: Payloads are padded with bytes 255 to a positive multiple of this.
BLOCK = 576
RATE = 8000
TAIL = 32
UNDECLARED = "application/octet-stream"


# -- formats ---------------------------------------------------------------------------------
# A validator gets the bytes and the offset of the file's start; it returns its length, or 0.


def riff(kind: bytes) -> Callable[[bytes, int], int]:
    def check(b: bytes, i: int) -> int:
        """The form type fits and whole chunks fill the stated length exactly; a WAVE has fmt
        before data, and WebP's first chunk is one of its own."""
        if len(b) < i + 12 or b[i + 8 : i + 12] != kind:
            return 0
        end = i + 8 + int.from_bytes(b[i + 4 : i + 8], "little")
        at, seen = i + 12, []
        if end > len(b):
            return 0
        while at + 8 <= end:
            seen.append(b[at : at + 4])
            at += 8 + (n := int.from_bytes(b[at + 4 : at + 8], "little")) + n % 2
        if at != end or not seen:
            return 0
        if kind == b"WAVE" and (b"fmt " not in seen or b"data" not in seen or seen.index(b"fmt ") > seen.index(b"data")):
            return 0
        if kind == b"WEBP" and seen[0] not in (b"VP8 ", b"VP8L", b"VP8X"):
            return 0
        return end - i

    return check


def png(b: bytes, i: int) -> int:
    """Chunks with right checksums from IHDR to IEND."""
    at = i + 8
    first = True
    while at + 12 <= len(b):
        n = int.from_bytes(b[at : at + 4], "big")
        kind = b[at + 4 : at + 8]
        if at + 12 + n > len(b) or first and (kind != b"IHDR" or n != 13):
            return 0
        if zlib.crc32(b[at + 4 : at + 8 + n]) != int.from_bytes(b[at + 8 + n : at + 12 + n], "big"):
            return 0
        at, first = at + 12 + n, False
        if kind == b"IEND":
            return at - i if n == 0 else 0
    return 0


def gif(b: bytes, i: int) -> int:
    """Blocks up to the trailer."""

    def blocks(at: int) -> int:
        while at < len(b) and b[at]:
            at += 1 + b[at]
        return at + 1

    if len(b) < i + 13:
        return 0
    at = i + 13 + (3 << (b[i + 10] & 7) + 1 if b[i + 10] & 0x80 else 0)
    images = 0
    while at < len(b):
        if b[at] == 0x3B:
            return at + 1 - i if images else 0
        if b[at] == 0x21:
            at = blocks(at + 2)
        elif b[at] == 0x2C and at + 10 <= len(b):
            at = blocks(at + 10 + (3 << (b[at + 9] & 7) + 1 if b[at + 9] & 0x80 else 0) + 1)
            images += 1
        else:
            return 0
    return 0


@lru_cache(maxsize=1)
def _lost(b: bytes) -> set[tuple[int, bool]]:
    """Places from which walks over segments have failed."""
    return set()


def jpeg(b: bytes, i: int) -> int:
    """Segments up to the start of scan, then entropy-coded data up to the end marker. Walks that meet where one has
    failed fail as well, so all starts together take one walk over the bytes."""
    walked: list[tuple[int, bool]] = []
    if not (n := _jpeg(b, i + 2, walked, _lost(b))):
        _lost(b).update(walked)
    return n - i if n else 0


def _jpeg(b: bytes, at: int, walked: list[tuple[int, bool]], lost: set[tuple[int, bool]]) -> int:
    """Where the image ends whose segments begin at ``at``; 0 if it doesn't."""
    frame = False
    while at + 4 <= len(b):
        if (at, frame) in lost:
            return 0
        walked.append((at, frame))
        if b[at] != 0xFF:
            return 0
        m, n = b[at + 1], int.from_bytes(b[at + 2 : at + 4], "big")
        if not (0xC0 <= m <= 0xFE) or m == 0xD9 or n < 2 or at + 2 + n > len(b):
            return 0
        frame |= m in (0xC0, 0xC1, 0xC2)
        at += 2 + n
        if m == 0xDA:
            if not frame:
                return 0
            while (at := b.find(b"\xff", at)) >= 0 and at + 1 < len(b):
                k = b[at + 1]
                if k == 0xD9:
                    return at + 2
                if k == 0 or 0xD0 <= k <= 0xD7:
                    at += 2
                elif k == 0xFF:
                    at += 1
                else:
                    break
            if at < 0 or at + 1 >= len(b):
                return 0
    return 0


def bmp(b: bytes, i: int) -> int:
    """The stated length holds headers and a whole uncompressed image."""
    if len(b) < i + 54:
        return 0
    size, _, offset, head, width, height, planes, bits, packed = struct.unpack_from("<IIIIiiHHI", b, i + 2)
    if not (offset >= 14 + head and head in (40, 52, 56, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and packed == 0 and width > 0 and height != 0):
        return 0
    need = offset + (width * bits + 31) // 32 * 4 * abs(height)
    return size if need <= size <= len(b) - i else 0


def pdf(b: bytes, i: int) -> int:
    """A version, and the last end-of-file mark, which startxref precedes, before another file."""
    if not b[i + 5 : i + 6].isdigit() or b[i + 6 : i + 7] != b".":
        return 0
    stop = b.find(b"%PDF-", i + 5)
    end = b.rfind(b"%%EOF", i, stop if stop >= 0 else len(b))
    return end + 5 - i if end > 0 and b.rfind(b"startxref", i, end) >= 0 else 0


def gzip_(b: bytes, i: int) -> int:
    """Inflates, and its checksum and length agree."""
    if len(b) < i + 18 or b[i + 3] & 0xE0:
        return 0
    d = zlib.decompressobj(31)
    try:
        view = memoryview(b)[i:]
        for k in range(0, len(view), 1 << 16):
            buf = view[k : k + (1 << 16)]
            while buf and not d.eof:
                d.decompress(buf, 1 << 20)
                buf = d.unconsumed_tail
            if d.eof:
                return min(k + (1 << 16), len(view)) - len(d.unused_data)
    except zlib.error:
        pass
    return 0


@lru_cache(maxsize=1)
def _zips(b: bytes) -> dict[int, int]:
    """Start -> length of all archives: each end-of-directory record says where its archive starts,
    so the bytes are searched once for all of them."""
    out, at = {}, -1
    while (at := b.find(b"PK\x05\x06", at + 1)) >= 0 and at + 22 <= len(b):
        size, offset, note = struct.unpack_from("<IIH", b, at + 12)
        i = at - size - offset
        if i >= 0 and at + 22 + note <= len(b) and b[i + offset : i + offset + 4] == b"PK\x01\x02":
            out.setdefault(i, at + 22 + note - i)
    return out


def zip_(b: bytes, i: int) -> int:
    """The end-of-directory record closes a directory that lies where it says."""
    return _zips(b).get(i, 0)


def ogg(b: bytes, i: int) -> int:
    """Pages of one stream, from its first to its last."""
    at, serial = i, b[i + 14 : i + 18]
    if len(b) < i + 28 or not b[i + 5] & 2:
        return 0
    while at + 27 <= len(b) and b[at : at + 5] == b"OggS\0" and b[at + 14 : at + 18] == serial:
        n = b[at + 26]
        last = b[at + 5] & 4
        at += 27 + n + sum(b[at + 27 : at + 27 + n])
        if at > len(b):
            return 0
        if last:
            return at - i
    return 0


def flac(b: bytes, i: int) -> int:
    """Metadata blocks from STREAMINFO on; audio frames run to the end."""
    at, first = i + 4, True
    while at + 4 <= len(b):
        kind, n = b[at], int.from_bytes(b[at + 1 : at + 4], "big")
        if first and (kind & 0x7F or n != 34) or (kind & 0x7F) == 127:
            return 0
        at, first = at + 4 + n, False
        if kind & 0x80:
            return len(b) - i if at + 2 <= len(b) and b[at] == 0xFF and b[at + 1] & 0xFC == 0xF8 else 0
    return 0


@dataclass(frozen=True)
class Format:
    mime: str
    magic: bytes
    check: Callable[[bytes, int], int]


FORMATS = (
    Format("audio/wav", b"RIFF", riff(b"WAVE")),
    Format("image/webp", b"RIFF", riff(b"WEBP")),
    Format("image/png", b"\x89PNG\r\n\x1a\n", png),
    Format("image/gif", b"GIF87a", gif),
    Format("image/gif", b"GIF89a", gif),
    Format("image/jpeg", b"\xff\xd8\xff", jpeg),
    Format("image/bmp", b"BM", bmp),
    Format("application/pdf", b"%PDF-", pdf),
    Format("application/gzip", b"\x1f\x8b\x08", gzip_),
    Format("application/zip", b"PK\x03\x04", zip_),
    Format("audio/ogg", b"OggS\0", ogg),
    Format("audio/flac", b"fLaC", flac),
)


@cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    by_magic: dict[str, list[Format]] = {}
    for f in FORMATS:
        by_magic.setdefault(f.magic.decode("latin-1"), []).append(f)
    for magic, formats in by_magic.items():
        a.add_word(magic, (len(magic), formats))
    a.make_automaton()
    return a


@dataclass(frozen=True)
class Found:
    mime: str
    start: int
    length: int


def sniff(data: bytes) -> list[Found]:
    """All valid files in ``data`` by offset. One inside another is reported too, except by a
    format of the same type at the same place. Empty bytes hold none."""
    found = []
    for end, (n, formats) in _automaton().iter(data.decode("latin-1")):
        start = end + 1 - n
        for f in formats:
            if length := f.check(data, start):
                found.append(Found(f.mime, start, length))
                break
    return sorted(found, key=lambda x: (x.start, -x.length))


def feature(data: bytes, declared: str) -> str:
    """``declared>actual`` and the embedded files as ``type@offset+length``. Without a known file
    at offset 0 the declared type stands."""
    found = sniff(data)
    own = next((x for x in found if x.start == 0), None)
    rest = [f"{x.mime}@{x.start}+{x.length}" for x in found if x is not own]
    return ";".join([f"{declared}>{own.mime if own else declared}", *rest])


# -- packing ---------------------------------------------------------------------------------


def to_wav(payload: bytes) -> bytes:
    pad = len(payload) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * pad


def from_wav(data: bytes) -> bytes | None:
    """The samples of the data chunk, as far as they are there; None for what isn't a WAVE file or has no data."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at = 12
    while at + 8 <= len(data):
        n = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"data":
            return data[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    return None


def pack_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, declared, media`` of every row: its text in UTF-8 (null: empty), padded, as
    WAVE. The declared type is the generic one, as it comes with undeclared uploads."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = [t.encode() if isinstance(t, str) else b"" for t in pdf["text"]]
            media = [to_wav(b + b"\xff" * (-len(b) % BLOCK or (0 if b else BLOCK))) for b in raw]
            yield pd.DataFrame({"id": pdf["id"], "n_bytes": [len(b) for b in raw], "declared": UNDECLARED, "media": media})

    d = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return d.mapInPandas(pack, "id string, n_bytes long, declared string, media binary").withColumn("id", F.col("id").cast("long"))


def _bytes(media) -> bytes:
    return bytes(media) if isinstance(media, (bytes, bytearray, memoryview)) else b""


def carve(stored: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """``id, mime, start, length, data`` of every file within stored media but the one that they are
    themselves: one row each, by its validated length. Null or empty media hold none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, media in zip(pdf["id"], map(_bytes, pdf["media"]), strict=True):
                for x in sniff(media):
                    if x.start:
                        yield pd.DataFrame({"id": [i], "mime": [x.mime], "start": [x.start], "length": [x.length], "data": [media[x.start : x.start + x.length]]})

    got = stored.select(F.col(id_col).cast("string").alias("id"), F.col(media_col).alias("media")).mapInPandas(run, "id string, mime string, start long, length long, data binary")
    return got.withColumn("id", F.col("id").cast(stored.schema[id_col].dataType))


def media_features(stored: DataFrame) -> DataFrame:
    """Features of stored media: see ``op8``. Null media counts as empty bytes, a null declared type as
    ``application/octet-stream``; of media that aren't WAVE the payload is all their bytes. Rows keep
    their number; equal media of equal declared type get equal values."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, n, declared, media in zip(*(pdf[c] for c in ("id", "n_bytes", "declared", "media")), strict=True):
                media = _bytes(media)
                payload = from_wav(media)
                payload = media if payload is None else payload
                rows.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), len(media), hashlib.sha256(media).hexdigest(), feature(media, declared if isinstance(declared, str) else UNDECLARED)))
            yield pd.DataFrame(rows, columns=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    out = stored.select(F.col("id").cast("string").alias("id"), "n_bytes", "declared", "media").mapInPandas(read, schema)
    return out.select(F.col("id").cast("long").alias("doc_id"), *[c for c in out.columns if c != "id"])


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows keep their number: repeated rows stay, equal texts get equal values, an empty table
    gives none. A null id stays null."""
    return media_features(materialize(pack_texts(table(spark, sf_dir, "documents")), "media"))
