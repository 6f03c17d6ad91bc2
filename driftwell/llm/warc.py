"""WARC archives in Zstandard frames: a writer, and a reader that checks what it reads.

An archive begins with a skippable frame that holds a Zstandard dictionary (plain, or itself compressed), if it
has one. After it comes one frame for each record, so records can be read and lost one by one.

Writing: the record of each page is a ``response`` with the payload, or, where an earlier page has the same
payload of at least ``least`` bytes, a ``revisit`` that refers to the page with the smallest id and has no
payload. First pages are found by a minimum for each digest, taken before rows move. Each task writes its rows
into archives of about ARCHIVE bytes in the folder shared by the cluster and trains the dictionary of an archive
from its first records (TRAIN bytes at most). A task's rows are sorted and its archives are named by partition and
number, so a task that runs again writes the same bytes under the same names.

Reading: Spark's binaryFile source reads archives, from any store; a task decodes them frame by frame and checks
the version line, the required headers, the block's length, the record's end, the HTTP header's length against
the payload, and the SHA-1 of payload and block. A record that doesn't hold is returned with ``error``.

Defined results: null html is an empty payload; null urls have no target header; characters that headers can't
hold are percent-encoded; a null page_id is written as an empty name, never stands for others, and is a response
unless another page has its payload; rows that repeat the smallest page_id of a payload are all responses;
other columns are ignored; an empty table gives no archives and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import materialise, shared_folder

ARCHIVE = 8 << 20
TRAIN = 2 << 20
DICTIONARY = 64 << 10
LEVEL = 3
SLICE = 64 << 10
#: Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
DATE = "2024-01-01T00:00:00Z"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "archive string, at long, page_id long, record_type string, url string, refers_to long, payload binary, payload_bytes long, payload_digest string, error string"


class WarcError(ValueError):
    """A record or archive that doesn't hold to the format."""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, first: bool = True) -> bytes:
    """The record's bytes: a response, or, if not ``first``, a revisit of the page ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if first else http
    headers = ["WARC/1.1", f"WARC-Type: {'response' if first else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        headers.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    headers += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if not first:
        headers += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {_name(refers_to)}"]
    headers.append(f"Content-Length: {len(block)}")
    return "\r\n".join(headers).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes) -> tuple[str, dict[str, str]]:
    lines = data.decode("utf-8", "replace").split("\r\n")
    found = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"not a header: {line[:60]!r}")
        found[name.lower()] = value.strip()
    return lines[0], found


def _page(name: str) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d*)>", name)
    if not m:
        raise WarcError(f"not a page's name: {name[:60]!r}")
    return int(m[1]) if m[1] else None


def parse_record(data: bytes) -> dict:
    """The fields of RECORD, from the bytes of one record; raises WarcError where it doesn't hold."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, headers = _headers(head)
    if not gap or version not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"not a WARC record: {version[:40]!r}")
    for name in REQUIRED:
        if name not in headers:
            raise WarcError(f"no {name}")
    if not headers["content-length"].isdecimal():
        raise WarcError("content-length isn't a number")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"block of {len(rest) - 4} bytes, content-length {length}")
    block, kind = rest[:length], headers["warc-type"]
    if "warc-block-digest" in headers and headers["warc-block-digest"] != f"sha1:{digest(block)}":
        raise WarcError("block digest differs")
    if kind not in ("response", "revisit"):
        raise WarcError(f"type {kind[:40]!r}")
    http, gap, payload = block.partition(b"\r\n\r\n")
    _, fields = _headers(http)
    size = fields.get("content-length", "")
    if not gap or not size.isdecimal():
        raise WarcError("no HTTP content-length")
    told = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and (len(payload) != int(size) or digest(payload) != told):
        raise WarcError("payload and its length or digest differ")
    if kind == "revisit" and (payload or "warc-refers-to" not in headers):
        raise WarcError("a revisit has a payload or refers to nothing")
    return {
        "page_id": _page(headers["warc-record-id"]), "record_type": kind, "url": headers.get("warc-target-uri"),
        "refers_to": _page(headers["warc-refers-to"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None, "payload_bytes": int(size), "payload_digest": told,
    }


def train(samples: list[bytes]) -> bytes | None:
    """A dictionary of the samples; where they are too few to learn from, of the records of blank pages as well."""
    blank = [make_record(i, f"http://host/{i}", b"<html><head><title></title></head><body><p>%d</p></body></html>" % i) for i in range(64)] if len(samples) < 64 else []
    for some in (samples, samples + blank):
        try:
            return zstandard.train_dictionary(DICTIONARY, some).as_bytes()
        except (zstandard.ZstdError, ValueError):
            continue
    return None


class ArchiveWriter:
    """Collects records into one archive's bytes; the dictionary is trained from the first TRAIN bytes."""

    def __init__(self) -> None:
        self.waiting: list[bytes] = []
        self.out = bytearray()
        self.compressor: zstandard.ZstdCompressor | None = None
        self.held = 0

    def add(self, record: bytes) -> None:
        if self.compressor:
            self.out += self.compressor.compress(record)
            return
        self.waiting.append(record)
        self.held += len(record)
        if self.held >= TRAIN:
            self._begin()

    def _begin(self) -> None:
        learned = train([r[: 64 << 10] for r in self.waiting])
        params = {"level": LEVEL, "write_content_size": True, "write_checksum": True}
        if learned:
            # The dictionary is compressed in its frame; readers take either form.
            packed = zstandard.ZstdCompressor(level=19).compress(learned)
            self.out += struct.pack("<II", SKIPPABLE, len(packed)) + packed
            self.compressor = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(learned), **params)
        else:
            self.compressor = zstandard.ZstdCompressor(**params)
        for record in self.waiting:
            self.out += self.compressor.compress(record)
        self.waiting = []

    def size(self) -> int:
        return len(self.out) + self.held * (not self.compressor)

    def finish(self) -> bytes:
        if not self.compressor:
            self._begin()
        return bytes(self.out)


def read_archive(data: bytes) -> Iterator[tuple[int, dict | None, str | None]]:
    """(offset, fields, error) of each record. After a frame that can't be decoded the rest can't be found."""
    at, dictionary = 0, None
    if data[:4] == struct.pack("<I", SKIPPABLE):
        size = struct.unpack_from("<I", data, 4)[0]
        content = data[8 : 8 + size]
        at = 8 + size
        try:
            if len(content) != size:
                raise WarcError("the dictionary's frame is cut off")
            if content[:4] == FRAME:
                content = zstandard.ZstdDecompressor().decompress(content)
            dictionary = zstandard.ZstdCompressionDict(content)
        except (zstandard.ZstdError, WarcError) as e:
            yield 0, None, f"dictionary: {e}"
            return
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(data):
        if 0x184D2A50 <= struct.unpack("<I", data[at : at + 4].ljust(4, b"\0"))[0] <= 0x184D2A5F:
            at += 8 + struct.unpack("<I", data[at + 4 : at + 8].ljust(4, b"\0"))[0]
            continue
        one, record, end = reader.decompressobj(), bytearray(), at
        try:
            while not one.eof and end < len(data):  # in slices, so that what follows isn't copied for each record
                record += one.decompress(memoryview(data)[end : end + SLICE])
                end = min(end + SLICE, len(data))
            if not one.eof:
                raise WarcError("the frame is cut off")
        except (zstandard.ZstdError, WarcError) as e:
            yield at, None, f"frame: {e}"
            return
        try:
            yield at, parse_record(bytes(record)), None
        except WarcError as e:
            yield at, None, str(e)
        at = end - len(one.unused_data)


def _save(folder: str, name: str, data: bytes) -> str:
    """Written beside its place and moved there, so that readers see whole archives."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", folder if ":" in folder else f"file://{folder}"))
    store.create_dir(path, recursive=True)
    beside = f"{path}/_{uuid.uuid4().hex}"
    with store.open_output_stream(beside) as out:
        out.write(data)
    store.move(beside, f"{path}/{name}")
    return f"{folder}/{name}"


def plan_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload (null for revisits, whose ``payload_bytes`` and digest stand), first, refers_to."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload"))
    shared = rows.filter(F.col("payload_bytes") >= least).groupBy("sha1", "payload_bytes").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1 and _first is not null")
    planned = rows.join(shared.drop("_n"), ["sha1", "payload_bytes"], "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    return planned.select("page_id", "url", "payload", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least: int = 0, archive: int = ARCHIVE) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html); the archives: (path, records)."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer, n, archives, partition = ArchiveWriter(), 0, 0, 0
        for rows in batches:
            done = []
            for page_id, url, payload, refers_to, partition in rows.itertuples(index=False, name=None):
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                writer.add(make_record(page_id, url, bytes(payload), refers_to, refers_to is None))
                n += 1
                if writer.size() >= archive:
                    done.append((_save(folder, f"{partition:07d}-{archives:05d}.warc.zst", writer.finish()), n))
                    writer, n, archives = ArchiveWriter(), 0, archives + 1
            yield pd.DataFrame(done, columns=["path", "records"])
        if n:
            yield pd.DataFrame([(_save(folder, f"{partition:07d}-{archives:05d}.warc.zst", writer.finish()), n)], columns=["path", "records"])

    planned = plan_records(pages, least).sortWithinPartitions("page_id", "refers_to", "url", "payload").withColumn("_partition", F.spark_partition_id())
    return materialise(planned.mapInPandas(write, "path string, records long"))


def read_archives(files: DataFrame) -> DataFrame:
    """The records (RECORD) of archives given as (path, content), as the binaryFile source has them."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in RECORD.split(", ")]
        for rows in batches:
            for path, content in zip(rows["path"], rows["content"], strict=True):
                found, held = [], 0
                for at, fields, error in read_archive(bytes(content)):
                    found.append({"archive": path, "at": at, "error": error} | (fields or {}))
                    held += (fields or {}).get("payload_bytes") or 0
                    if held > 16 << 20 or len(found) >= 4096:
                        yield _typed(found, columns)
                        found, held = [], 0
                yield _typed(found, columns)

    return files.select("path", "content").mapInPandas(read, RECORD)


def _typed(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=columns)
    return df.astype({c: "Int64" for c in ("at", "page_id", "refers_to", "payload_bytes")})


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write archives of ``pages`` to a new folder of the shared one, and read them back."""
    folder = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    archives = write_archives(pages, folder, least)
    spark = pages.sparkSession
    if not archives.limit(1).count():
        return spark.createDataFrame([], RECORD)
    return read_archives(spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder))
