import hashlib
import struct

import pytest
import zstandard

from sparkloom.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, first string"
LONG = "<p>" + "same text " * 30 + "</p>"
ROWS = [(3, "http://a/x?y=é\r\nX: 1", LONG, "c", "d"), (1, "http://b", LONG, "c", "d"), (2, None, LONG, "c", "d"), (4, "http://c", None, "c", "d"), (5, "http://c", "", "c", "d"), (6, "u", "short", "c", "d"), (7, "u", "short", "c", "d"), (8, "u", "ü" * 200_000, "c", "d"), (1, "http://b", LONG, "c", "d"), (None, "n", "null id" * 40, "c", "d"), (None, "n", "null id" * 40, "c", "d")]


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    got = warc.round_trip(pages).collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    for i, _, html, *_ in ROWS:
        body = (html or "").encode()
        for r in by[i]:
            assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
    assert [(r.record_type, r.refers_to) for r in by[1]] == [("response", None)] * 2
    assert [(by[i][0].record_type, by[i][0].refers_to) for i in (2, 3, 5, 6, 7)] == [("revisit", 1), ("revisit", 1), ("response", None), ("response", None), ("response", None)]
    assert {r.record_type for r in by[None]} == {"response"}
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def archive(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    return warc.write(warc.plan(pages).coalesce(1)).collect()[0]


def test_layout_dictionary_first_then_a_frame_a_record(spark):
    a = archive(spark)
    assert struct.unpack_from("<I", a.content)[0] == warc.SKIPPABLE
    records = [r for _, r in warc._frames(bytes(a.content))]
    assert len(records) == len(ROWS) and all(r.startswith(b"WARC/1.1\r\n") for r in records)
    size = struct.unpack_from("<I", a.content, 4)[0]
    with pytest.raises(zstandard.ZstdError):  # frames need the dictionary
        zstandard.ZstdDecompressor().decompress(bytes(a.content)[8 + size :])


def test_payloads_and_addresses_come_back(spark):
    back = warc.read(spark.createDataFrame([archive(spark)]), keep_payload=True).collect()
    assert {bytes(r.payload).decode() for r in back if r.page_id == 8} == {"ü" * 200_000}
    assert {r.url for r in back if r.page_id == 3} == {ROWS[0][1]} and {r.url for r in back if r.page_id == 2} == {None}


@pytest.mark.parametrize("spoil", ["cut", "flip", "frame", "length"])
def test_broken_archives_are_refused(spark, spoil):
    data = bytearray(archive(spark).content)
    if spoil == "cut":
        data = data[:-20]
    elif spoil == "flip":
        data[-60] ^= 0xFF
    elif spoil == "frame":
        data += b"not a frame at all"
    length = len(data) + (spoil == "length")
    df = spark.createDataFrame([("p", length, bytes(data))], warc.ARCHIVES)
    with pytest.raises(Exception, match="BadArchive"):
        warc.read(df).collect()


@pytest.mark.parametrize("record", [b"junk", b"WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\n", b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nWARC-Date: d\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n", b"WARC/1.1\r\nno colon\r\n\r\n\r\n\r\n"])
def test_bad_records(record):
    with pytest.raises(warc.BadArchive):
        warc._parse(record)


def test_plain_archives_without_dictionary(spark):
    record = warc._record(9, "http://z", b"hello", 5, hashlib.sha256(b"hello").hexdigest(), "response", None)
    data = zstandard.ZstdCompressor().compress(record) * 2
    got = warc.read(spark.createDataFrame([("p", len(data), data)], warc.ARCHIVES)).collect()
    assert [(r.page_id, r.payload_bytes) for r in got] == [(9, 5), (9, 5)]


def test_archives_are_files_that_others_read(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    files = warc.write_files(warc.plan(pages), str(tmp_path), archive_bytes=2000).collect()
    there = sorted(p for p in tmp_path.iterdir() if not p.name.startswith("."))
    assert len(there) > 1 and {(p.name, p.stat().st_size) for p in there} == {(r.path, r.length) for r in files}
    assert all(p.name.endswith(".warc.zst") and hashlib.sha256(p.read_bytes()).hexdigest().startswith(p.name[:24]) for p in there)
    back = warc.read(spark.read.format("binaryFile").load(str(tmp_path)))
    assert sorted(map(str, (r.page_id for r in back.collect()))) == sorted(str(r[0]) for r in ROWS)
