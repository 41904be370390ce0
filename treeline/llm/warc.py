"""WARC archives compressed with a Zstandard dictionary.

The layout is that of the public ``.warc.zst`` proposal: the dictionary lies in a leading
skippable frame (magic 0x184D2A5D), and every record is one Zstandard frame of its own, compressed
with it, so that a reader can start at any record. Each task writes archives of its own rows with
a dictionary of their own, built from the first records; no record passes through the driver.

Records with equal payloads of at least ``MIN_REVISIT`` bytes are written once as a response; the
others become revisits of it.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, materialize_narrow, shared_path, table
from .fsio import open_file, write_file

MAGIC = 0x184D2A5D
MIN_REVISIT = 100
#: An archive is closed at this many records, and the dictionary is built from up to this many
#: bytes of its first records.
RECORDS = 20_000
SAMPLE_BYTES = 4 << 20
DICT_BYTES = 64 << 10
LEVEL = 3
#: Digests of repeated payloads are broadcast up to this many (about 100 bytes each); beyond, they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _clean(value) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", str(value))


def record_id(page_id, kind: str, digest: str) -> str:
    """A record's name follows from its page, kind and payload digest, so that a revisit can name its
    response's. Rows repeated in full have one response."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{kind}/{digest}')}>"


def record(page_id, url, payload: bytes, digest: str, n_bytes: int, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record. A revisit has no payload; its full payload's size and digest stay in
    the headers."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id, kind, digest)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_clean(url) if url else 'urn:page'}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {n_bytes}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, 'response', digest)}", f"X-Refers-To-Page-ID: {'' if refers_to is None else refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def build_dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on the records; too few or too small to train on, their own bytes serve as one."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICT_BYTES:] or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of an archive, piece by piece. Only the sample is held in memory."""
    sample, size = [], 0
    for r in records:
        sample.append(r)
        size += len(r)
        if size >= SAMPLE_BYTES:
            break
    d = build_dictionary(sample)
    raw = d.as_bytes()
    yield struct.pack("<II", MAGIC, len(raw)) + raw
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=True, write_checksum=True)
    for r in sample:
        yield packer.compress(r)
    sample.clear()
    for r in records:
        yield packer.compress(r)


def read_archive(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of every record of an archive, reading it in pieces."""
    magic, n = struct.unpack("<II", stream.read(8))
    if magic != MAGIC:
        raise ValueError("not a dictionary-compressed WARC archive")
    raw = stream.read(n)
    trained = raw[:4] == b"\x37\xa4\x30\xec"
    d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
    unpacker, rest = zstandard.ZstdDecompressor(dict_data=d), b""
    while True:
        if not rest and not (rest := stream.read(1 << 20)):
            return
        out, one = [], unpacker.decompressobj()
        while not one.eof:
            if not rest and not (rest := stream.read(1 << 20)):
                raise ValueError("archive ends within a record")
            out.append(one.decompress(rest))
            rest = one.unused_data if one.eof else b""
        head, _, block = b"".join(out).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        block = block[: int(headers["Content-Length"])]
        yield headers, block.partition(b"\r\n\r\n")[2]


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Write a record for every row; returns ``path, n_records, n_bytes``, one row an archive.

    A null body is empty, a null id or URL is left empty in the record. Of records with equal
    bodies of at least ``MIN_REVISIT`` bytes the one with the least id (null last; of repeated
    rows the first in the files) is the response. Other columns are ignored. An empty table gives
    no archive.
    """
    body = F.encode(F.coalesce(F.col(body_col), F.lit("")), "UTF-8")
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), body.alias("body")).withColumns({"digest": F.sha2("body", 256), "n": F.octet_length("body"), "place": F.monotonically_increasing_id()})
    # Written down, so that a row's place is the same wherever it is read.
    p = materialize(p, "warc-pages")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "place")
    firsts = p.filter(F.col("n") >= MIN_REVISIT).groupBy(F.col("digest").alias("d")).agg(F.min(order).alias("first"), F.count("*").alias("c")).filter("c > 1")
    firsts = materialize_narrow(firsts.select("d", F.col("first.id").alias("first_id"), F.col("first.place").alias("first_place")), "warc-first")
    firsts = F.broadcast(firsts) if firsts.count() <= BROADCAST_ROWS else firsts
    again = F.col("place") != F.coalesce("first_place", "place")
    joined = p.join(firsts, F.col("digest") == F.col("d"), "left").select("id", "url", F.when(~again, F.col("body")).alias("body"), "digest", "n", again.alias("again"), "first_id")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for pdf in batches:
                for id_, url, body, digest, n, again, first in zip(*(pdf[c].tolist() for c in pdf.columns), strict=True):
                    id_, first = (None if x is None or x != x else int(x) for x in (id_, first))
                    yield record(id_, url, body, digest, n, "revisit" if again else "response", first)

        it, done = rows(), False
        while not done:
            head = next(it, None)
            if head is None:
                return
            count = 0

            def limited(head=head):
                nonlocal count, done
                count = 1
                yield head
                while count < RECORDS:
                    r = next(it, None)
                    if r is None:
                        done = True
                        return
                    count += 1
                    yield r

            path, size = write_file(folder, ".warc.zst", archive(limited()))
            yield pd.DataFrame({"path": [path], "n_records": [count], "n_bytes": [size]})

    # The list of archives is written down: it names just the files of the attempts that counted.
    return materialize(joined.withColumns({"id": F.col("id").cast("string"), "first_id": F.col("first_id").cast("string")}).mapInPandas(write, "path string, n_records long, n_bytes long"), "warc-list")


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record of the archives in ``path``: ``page_id, url, payload, payload_bytes,
    payload_digest, record_type, refers_to``. Digest and size of a response are those of the bytes
    read; they must agree with its headers. A revisit must name the record of the page and digest that it
    refers to, whose payload is checked where that record is read."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                rows, held = [], 0
                with open_file(path) as stream:
                    for h, payload in read_archive(stream):
                        revisit = h["WARC-Type"] == "revisit"
                        said, n = h["WARC-Payload-Digest"].removeprefix("sha256:"), int(h["X-Payload-Length"])
                        if not revisit and (len(payload) != n or hashlib.sha256(payload).hexdigest() != said):
                            raise ValueError(f"{path}: payload differs from its header")
                        to, page = h.get("X-Refers-To-Page-ID"), h["X-Page-ID"] or None
                        if h["WARC-Record-ID"] != record_id(page, h["WARC-Type"], said) or revisit and h["WARC-Refers-To"] != record_id(to or None, "response", said):
                            raise ValueError(f"{path}: a record's name differs from what it holds")
                        rows.append((int(page) if page else None, h["WARC-Target-URI"], None if revisit else payload, n, said, h["WARC-Type"], int(to) if to else None))
                        held += len(payload)
                        if held > 16 << 20 or len(rows) >= 5000:
                            yield frame(rows)
                            rows, held = [], 0
                yield frame(rows)

    def frame(rows) -> pd.DataFrame:
        pdf = pd.DataFrame(rows, columns=["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        return pdf.astype({"page_id": "Int64", "refers_to": "Int64"})

    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return archives.select("path").repartition(max(1, min(archives.count(), 10_000))).mapInPandas(read, schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(table(spark, sf_dir, "pages"), shared_path(spark, "warc"))
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_sql() -> str:
    return f"""
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
    q AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
    r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM q)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id <> first_id THEN first_id END AS refers_to FROM r"""
