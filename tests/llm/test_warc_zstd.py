"""WARC archives as an exact round trip, and what must be refused."""

import base64
import hashlib

import pytest
import zstandard

from siftstone.llm.warc_zstd import SAMPLES, WarcError, learn, load, read_archive, read_archives, record, save, stored, train, write_archive, write_archives

ROWS = [(1, "http://a.org/", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "http://b.org/x y\r\nz", None), (4, "http://c.org", ""), (5, "http://d.org", "é漢" * 20000), (7, "u", "<p>same</p>"), (1, "http://a.org/", "<p>same</p>"), (None, "n", "<p>same</p>"), (None, "n", "only"), *((100 + i, f"http://h{i}.org/", f"<html><body>page {i} " + "text " * 300 + "</body></html>") for i in range(60))]


def plain(rows, least):
    out = []
    for k, _, html in rows:
        data = (html or "").encode()
        ids = [i for i, _, h in rows if (h or "").encode() == data and i is not None]
        first = min(ids) if ids and len(data) >= least else None
        revisit = first is not None and first != k and sum((h or "").encode() == data for _, _, h in rows) > 1
        out.append((k, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "clash") for r in ROWS], "page_id long, url string, html string, first string")
    for least in (0, 12):
        archives = stored(write_archives(pages, least_bytes=least))
        got = read_archives(archives)
        assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got.collect()), key=str) == plain(ROWS, least)
    texts = {(r["page_id"], bytes(r["payload"]).decode()) for r in got.collect() if r["payload"] is not None}
    assert (5, "é漢" * 20000) in texts and (4, "") in texts
    save(archives, str(tmp_path / "files"))
    assert read_archives(load(spark, str(tmp_path / "files"))).count() == len(ROWS)
    assert write_archives(pages.limit(0)).count() == 0


def test_sample_of_the_dictionary(spark):
    """The same whatever the partitions, with many rows of one id or none, and for an empty table."""
    rows = [(i, f"http://h{i}.org/", f"<p>{i} " + "word " * 100) for i in range(3 * SAMPLES)] + [(7, "http://copy.org/", "copy")] * 500 + [(None, None, None)] * 500
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    once = learn(pages.repartition(7), "page_id", "url", "html")
    assert once == learn(pages.orderBy("html").coalesce(2), "page_id", "url", "html") and len(once) > 1000
    assert learn(pages.limit(0), "page_id", "url", "html") == train([])


def test_dictionary_and_frames():
    records = [record(i, "http://x.org/", (f"<html>{i} " + "word " * 400).encode()) for i in range(100)]
    data = write_archive(records, train(records))
    assert data[:4] == bytes.fromhex("5d2a4d18")
    assert [r["headers"]["warc-record-id"] for r in read_archive(data)] == [f"<urn:page:{i}>" for i in range(100)]
    few = write_archive(records[:2], train(records[:2]))
    assert few[:4] == bytes.fromhex("5d2a4d18") and len(list(read_archive(few))) == 2 and list(read_archive(b"")) == []


def test_refused():
    good = record(1, "http://x.org/", b"<p>hello</p>")
    whole = write_archive([good], train([good]))
    bad = [whole[:-3], whole[: len(whole) // 2], b"junk" + whole, whole[:-1] + bytes([whole[-1] ^ 1])]
    for text in (good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"hello", b"hell"), good.replace(b"hello", b"jello"), good[:-2], good.replace(b"WARC-Date", b"X-Date"), good.replace(b"Content-Type: application", b"bad line")):
        bad.append(zstandard.ZstdCompressor().compress(text))
    for data in bad:
        with pytest.raises(WarcError):
            list(read_archive(data))


def test_every_archive_has_a_dictionary():
    for n in (0, 1, 3, 100):
        records = [record(i, "http://x.org/", f"<html>{i} ".encode() * (1 + 40 * (n > 3))) for i in range(n)]
        data = write_archive(records, train(records))
        assert data[:4] == bytes.fromhex("5d2a4d18") and int.from_bytes(data[4:8], "little") > 20
        assert [r["payload"] for r in read_archive(data)] == [r.partition(b"\r\n\r\n")[2].partition(b"\r\n\r\n")[2][:-4] for r in records]


def test_archives_of_others(spark):
    """Ids of any form, records that are not HTTP, no digest, and frames without a content size."""
    head = lambda kind, uuid, block, more=b"": b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nWARC-Record-ID: <urn:uuid:" + uuid + b">\r\nWARC-Date: 2020-01-01T00:00:00Z\r\n" + more + b"Content-Length: " + str(len(block)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    page = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\nhello"
    records = [head(b"warcinfo", b"a-1", b"software: x\r\n", b"Content-Type: application/warc-fields\r\n"), head(b"response", b"a-2", page, b"Content-Type: application/http;msgtype=response\r\n"), head(b"resource", b"a-3", b"\x00\x01", b"Content-Type: image/png\r\n"), head(b"revisit", b"a-4", b"HTTP/1.1 304 x\r\nContent-Length: 5\r\n\r\n", b"WARC-Refers-To: <urn:uuid:a-2>\r\nContent-Type: application/http\r\n")]
    press = zstandard.ZstdCompressor(write_content_size=False)
    data = b""
    for r in records:
        one = press.compressobj()
        data += one.compress(r) + one.flush()
    got = read_archives(spark.createDataFrame([("x", bytearray(data))], "name string, content binary")).collect()
    assert [(r["record_id"], r["page_id"], r["record_type"], r["payload_bytes"]) for r in got] == [("<urn:uuid:a-1>", None, "warcinfo", 13), ("<urn:uuid:a-2>", None, "response", 5), ("<urn:uuid:a-3>", None, "resource", 2), ("<urn:uuid:a-4>", None, "revisit", 5)]
    assert got[1]["payload_digest"] == base64.b32encode(hashlib.sha1(b"hello").digest()).decode() and got[3]["payload_digest"] is None
    with pytest.raises(WarcError):
        list(read_archive(data[:-3]))
