from __future__ import annotations

import base64
import hashlib
import random
import struct

import duckdb
import pytest
import zstandard

from driftwell.llm.common import shared_folder, table
from driftwell.llm.q_warc import SQL, op5_warc
from driftwell.llm.warc import SKIPPABLE, ArchiveWriter, WarcError, make_record, parse_record, read_archive, read_archives, round_trip, write_archives

SCHEMA = "page_id long, url string, html string, payload string, sha1 int"


def html(rnd):
    return "<p>" + " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "<b>", "é"]) for _ in range(rnd.randrange(400, 900)))


def test_record_round_trip_and_faults():
    record = make_record(7, "http://a.b/ü \r\nX: y", b"a\r\n\r\nb")
    got = parse_record(record)
    assert (got["page_id"], got["payload"], got["payload_bytes"], got["record_type"]) == (7, b"a\r\n\r\nb", 6, "response")
    assert got["payload_digest"] == base64.b32encode(hashlib.sha1(b"a\r\n\r\nb").digest()).decode()
    assert parse_record(make_record(8, None, b"abc", 7, False)) | {"url": None} == {
        "page_id": 8, "record_type": "revisit", "url": None, "refers_to": 7, "payload": None, "payload_bytes": 3, "payload_digest": base64.b32encode(hashlib.sha1(b"abc").digest()).decode(),
    }
    for bad in (record[:-1], record + b"x", record.replace(b"WARC/1.1", b"WARC/9.9", 1), record.replace(b"WARC-Date", b"WARC-Dote"), record.replace(b"\r\n\r\nb", b"\r\n\r\nc"), b"", b"WARC/1.1\r\nnothing\r\n\r\n\r\n\r\n"):
        with pytest.raises(WarcError):
            parse_record(bad)


def test_archive_has_a_dictionary_and_a_frame_for_each_record():
    rnd, writer = random.Random(1), ArchiveWriter()
    records = [make_record(i, None, html(rnd).encode()) for i in range(900)]
    for r in records:
        writer.add(r)
    data = writer.finish()
    magic, size = struct.unpack_from("<II", data)
    assert magic == SKIPPABLE and zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])[:4] == b"\x37\xa4\x30\xec"
    got = list(read_archive(data))
    assert [f["page_id"] for _, f, _ in got] == list(range(900)) and len({at for at, _, _ in got}) == 900
    plain = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
    again = struct.pack("<II", SKIPPABLE, len(plain)) + plain + data[8 + size :]
    assert [f for _, f, _ in read_archive(again)] == [f for _, f, _ in got]
    cut = list(read_archive(data[:-9]))
    assert len(cut) == 900 and cut[-1][1] is None and "frame" in cut[-1][2]
    assert list(read_archive(data[8 + size :]))[0][1] is None  # without its dictionary
    empty = struct.pack("<II", SKIPPABLE + 1, 3) + b"abc" + zstandard.compress(records[0])
    assert [f["page_id"] for _, f, _ in read_archive(empty)] == [0]
    assert list(read_archive(b"")) == []


def test_as_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf_dir}/pages.parquet')")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    want = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({SQL})").fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in op5_warc(spark, sf_dir).collect()) == want


def test_payloads_and_urls_come_back(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    want = {r.page_id: (r.url, r.html.encode()) for r in pages.collect()}
    got = {r.page_id: (r.url, bytes(r.payload)) for r in round_trip(pages, least=1 << 40).collect()}
    assert got == want


def test_many_archives_and_read_faults(spark):
    rnd = random.Random(2)
    pages = spark.createDataFrame([(i, f"http://a/{i}", html(rnd), "x", 1) for i in range(300)], SCHEMA).repartition(3)
    folder = f"{shared_folder(spark)}/many"
    archives = write_archives(pages, folder, archive=40_000)
    assert archives.count() > 3 and archives.agg({"records": "sum"}).first()[0] == 300
    files = spark.read.format("binaryFile").load(folder)
    assert read_archives(files).filter("error is null").count() == 300
    broken = files.selectExpr("path", "substring(content, 1, octet_length(content) - 5) as content")
    assert read_archives(broken).filter("error is not null").count() == archives.count()


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "u", ""), (5, "u", "x" * 3_000_000), (3, "u", "x" * 3_000_000), (3, "v", "x" * 3_000_000), (None, "u", "x" * 3_000_000), (None, None, "n"), (None, None, "n"), (9, "", "\x00é")]
    pages = spark.createDataFrame([(i, u, h, "clash", 0) for i, u, h in rows], SCHEMA)
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.error) for r in round_trip(pages).collect()), key=str)
    big = 3_000_000
    assert got == sorted([(1, "response", None, 0, None), (2, "revisit", 1, 0, None), (5, "revisit", 3, big, None), (3, "response", None, big, None), (3, "response", None, big, None), (None, "revisit", 3, big, None), (None, "response", None, 1, None), (None, "response", None, 1, None), (9, "response", None, 3, None)], key=str)
    assert round_trip(pages.filter("page_id > 99")).count() == 0


def test_archives_of_few_records_have_a_dictionary():
    for n in (1, 2, 5):
        writer = ArchiveWriter()
        records = [make_record(i, f"http://h/{i}", f"<html><p>page {i} of a site with the same words on each page</p></html>".encode()) for i in range(n)]
        for r in records:
            writer.add(r)
        data = writer.finish()
        assert data[:4] == (0x184D2A5D).to_bytes(4, "little")
        assert [f["page_id"] for _, f, error in read_archive(data) if not error] == list(range(n))
