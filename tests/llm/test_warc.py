"""WARC archives: an exact round trip, the format by hand, and damage."""

import hashlib
import struct

import pytest
import zstandard

from fairlake.llm import queries, warc

SCHEMA = "page_id long, url string, html string, digest string, first long, d int"


def slow(rows, least=100):
    out, first = [], {}
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= least and page is not None:
            first[data] = min(page, first.get(data, page))
    for page, _, html in rows:
        data = (html or "").encode()
        low = first.get(data) if len(data) >= least else None
        refers = low if low is not None and low != page else None
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=str)


def fast(spark, df):
    found = warc.archive_pages(spark, df).collect()
    assert not [r.error for r in found if r.error]
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str)


def make(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, 2) for i, u, h in rows], SCHEMA).repartition(3)


def test_round_trip_with_edge_cases(spark):
    same = "<p>the same page, again and again</p>" * 20
    rows = [(i, f"http://h/{i}", same) for i in (9, 4, 30)] + [(i, None, f"<p>page {i} é</p>" * i) for i in range(50, 60)]
    rows += [(70, "http://h/ \r\nX: y", "short"), (71, "", "short"), (72, None, None), (73, None, ""), (74, "u", "WARC/1.1\r\n\r\n" * 30),
             (75, "u", "x" * 3_000_000), (76, "v", "x" * 3_000_000), (77, "\U0001f600", "a" * 99), (78, "w", "a" * 99), (79, "w", "b" * 100), (80, "w", "b" * 100)]
    assert fast(spark, make(spark, rows)) == slow(rows)
    whole = {r.url: bytes(r.payload) for r in warc.read_archives(warc.write_archives(make(spark, rows))).where("payload_bytes > 1000000 AND record_type = 'response'").collect()}
    assert whole == {"u": b"x" * 3_000_000}


def test_empty_table_and_repeated_rows(spark):
    assert fast(spark, make(spark, [])) == []
    rows = [(3, "u", "z" * 200)] * 2 + [(5, "u", "z" * 200), (None, None, "z" * 200), (None, "u", "q" * 300), (None, "u", "q" * 300)]
    assert fast(spark, make(spark, rows)) == slow(rows)


def test_query_over_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted(map(tuple, queries.QUERIES["op3_warc"](spark, sf).collect()), key=str) == slow(rows)


def record(payload=b"<html>", **changes):
    data = warc.record_bytes("urn:x-page:1", "http://a/", payload, "2024-01-01T00:00:00Z", hashlib.sha256(payload).hexdigest(), None)
    for old, new in changes.items():
        data = data.replace(old.replace("_", "-").encode(), new)
    return data


def archive(tmp_path, *records, dictionary=b"", lead=True):
    held = warc._dictionary(dictionary)
    compressor = zstandard.ZstdCompressor(dict_data=held) if held else zstandard.ZstdCompressor()
    path = tmp_path / "a.warc.zst"
    top = struct.pack("<II", 0x184D2A5D, len(dictionary)) + dictionary if lead else b""
    path.write_bytes(top + b"".join(compressor.compress(r) for r in records))
    return path


@pytest.mark.parametrize("data, says", [
    (record().replace(b"WARC/1.1", b"WARC/9"), "version"),
    (record().replace(b"WARC-Date", b"X-Date"), "warc-date"),
    (record() + b"x", "length"),
    (record().replace(b"<html>", b"<HTML>"), "payload"),
    (record().replace(b"HTTP/1.1", b"FTTP/1.1"), "HTTP"),
    (record().replace(b"response\r\nWARC-Record", b"revisit\r\nWARC-Record"), "revisit"),
    (b"junk", "end"),
])
def test_wrong_records_are_told_and_skipped(tmp_path, data, says):
    path = archive(tmp_path, record(), data, record(b"two"))
    found = list(warc.read_archive(path.as_uri()))
    assert [bool(r["error"]) for r in found] == [False, True, False] and says in found[1]["error"]


def test_dictionaries_and_damaged_files(tmp_path):
    samples = [record(f"<html><p>{i} some page with common parts</p>".encode() * 5) for i in range(300)]
    trained = warc.train_dictionary(samples)
    assert trained[:4] == struct.pack("<I", 0xEC30A437)
    for dictionary in (trained, zstandard.ZstdCompressor().compress(trained), b"raw content of a dictionary", b""):
        plain = trained if dictionary[:4] == struct.pack("<I", 0xFD2FB528) else dictionary
        path = archive(tmp_path, *samples[:20], dictionary=plain)
        if dictionary != plain:
            body = path.read_bytes()[8 + len(plain):]
            path.write_bytes(struct.pack("<II", 0x184D2A5D, len(dictionary)) + dictionary + struct.pack("<I", 0x184D2A50) + struct.pack("<I", 3) + b"abc" + body)
        assert [r["error"] for r in warc.read_archive(path.as_uri())] == [None] * 20
    whole = path.read_bytes()
    path.write_bytes(whole[:-5])
    assert list(warc.read_archive(path.as_uri()))[-1]["error"] == "a frame is cut short"
    path.write_bytes(whole + b"\x01\x02")
    assert list(warc.read_archive(path.as_uri()))[-1]["error"] == "bytes follow the last frame"
    path.write_bytes(whole[8:])
    assert "dictionary frame" in list(warc.read_archive(path.as_uri()))[0]["error"]
