import io
import struct

import pytest
import zstandard

from treeline.llm import warc
from treeline.llm.common import shared_path

LONG = "<html>" + "word " * 60 + "</html>"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(3, "http://a/3", LONG, "k"), (1, "http://a/1", LONG, None), (2, None, "short", "k"), (4, "u\r\nX: y", "short", None), (5, "http://a/5", None, "k"), (6, "e", "", None)]
    rows += [(7, "x", LONG + "é😀", None), (7, "x", LONG + "é😀", None), (None, "n", LONG, None), (8, "big", "z" * 3_000_000, None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string")


def test_round_trip(spark, pages):
    got = warc.read_archives(warc.write_archives(pages, shared_path(spark, "t"))).collect()
    assert len(got) == pages.count()
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    assert by[1][0].record_type == "response" and bytes(by[1][0].payload).decode() == LONG
    for k in (3, None):
        assert by[k][0].record_type == "revisit" and by[k][0].refers_to == 1 and by[k][0].payload is None
        assert by[k][0].payload_bytes == len(LONG) and by[k][0].payload_digest == by[1][0].payload_digest
    assert [by[k][0].record_type for k in (2, 4, 5, 6)] == ["response"] * 4  # small ones
    assert by[5][0].payload_bytes == 0 and bytes(by[6][0].payload) == b""
    assert sorted(r.record_type for r in by[7]) == ["response", "revisit"] and {r.refers_to for r in by[7]} == {None, 7}
    assert by[8][0].payload_bytes == 3_000_000
    assert "\n" not in by[4][0].url


def test_revisits_name_the_record_of_their_response(spark, pages):
    paths = [r.path for r in warc.write_archives(pages.repartition(3, "url"), shared_path(spark, "t")).collect()]
    heads = [h for p in paths for h, _ in warc.read_archive(warc.open_file(p))]
    responses = {h["WARC-Record-ID"]: h for h in heads if h["WARC-Type"] == "response"}
    revisits = [h for h in heads if h["WARC-Type"] == "revisit"]
    assert len(revisits) == 3
    for h in revisits:
        to = responses[h["WARC-Refers-To"]]
        assert to["WARC-Payload-Digest"] == h["WARC-Payload-Digest"] and to["X-Page-ID"] == h["X-Refers-To-Page-ID"]


def test_clashing_columns(spark, pages):
    odd = pages.selectExpr("*", "1 AS id", "'b' AS body", "2 AS n", "3 AS place", "'c' AS d", "4 AS first_id", "5 AS again")
    got = warc.read_archives(warc.write_archives(odd, shared_path(spark, "t")))
    assert got.count() == pages.count() and got.filter("record_type = 'revisit'").count() == 3


def test_layout():
    records = [warc.record(i, "u", b"payload %d " % i * 30, "00" * 32, 0, "response", None) for i in range(300)]
    data = b"".join(warc.archive(iter(records)))
    magic, n = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D
    d = zstandard.ZstdCompressionDict(data[8 : 8 + n])
    # every record is a frame of its own that the dictionary opens
    one = zstandard.ZstdDecompressor(dict_data=d).decompressobj()
    assert one.decompress(data[8 + n :]) == records[0] and one.unused_data
    with pytest.raises(zstandard.ZstdError):
        zstandard.ZstdDecompressor().decompress(data[8 + n :])
    assert len(list(warc.read_archive(io.BytesIO(data)))) == 300


def test_a_single_small_record():
    data = b"".join(warc.archive(iter([warc.record(None, None, b"", "0" * 64, 0, "response", None)])))
    assert [h["WARC-Type"] for h, _ in warc.read_archive(io.BytesIO(data))] == ["response"]


def test_damage_is_noticed():
    data = b"".join(warc.archive(iter([warc.record(1, "u", b"x" * 500, "0" * 64, 500, "response", None)])))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.read_archive(io.BytesIO(data[:-20])))
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(b"12345678")))


def test_many_archives(spark, monkeypatch):
    p = spark.range(50).selectExpr("id AS page_id", "'u' AS url", "concat('page ', id) AS html").coalesce(1)
    monkeypatch.setattr(warc, "RECORDS", 7)
    archives = warc.write_archives(p, shared_path(spark, "t"))
    assert archives.selectExpr("sum(n_records)").first()[0] == 50
    assert warc.read_archives(archives).select("page_id").distinct().count() == 50


def test_empty_table(spark):
    p = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(p, shared_path(spark, "t"))).count() == 0


def test_query_against_sql(spark):
    from tests.conftest import DATA, duck_rows, rows

    assert rows(warc.op3(spark, DATA)) == duck_rows(warc.op3_sql())
