"""Zstandard WARC archives: a writer, and a reader that validates what it reads.

An archive (.warc.zst) may start with a skippable frame that holds the Zstandard dictionary, itself compressed or
plain; after it comes one frame for each record. The reader loads the dictionary, streams frame by frame, and checks
for each record the version line, the mandatory headers, Content-Length against the block, the closing line ends, that
the frame ends with the record, and the block's and payload's digests.

Pages become records: of those with equal payloads of at least ``least_bytes`` the one of smallest page_id is a
response and the others are revisits of it; smaller payloads are always responses. A revisit keeps the HTTP headers,
with the payload's length, and names the payload's digest and the response's id.

Archives lie in a folder that driver and executors share; tasks write them under new names, and only those that a
task returned when it ended well are read, so lost executors leave no half archive in the data.

Defined cases: null html is the empty payload; null url has no target header; rows of equal page_id and payload are
all of the kind that their page_id gives; a null page_id is never smaller than another, and is the response only where
no other is; an empty table writes no archive and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Table, checked_broadcast, shared_root, small_batches, utf8

# Fixed values of the formats.
DICTIONARY_MAGIC, FRAME_MAGIC = (0x184D2A5D).to_bytes(4, "little"), (0xFD2FB528).to_bytes(4, "little")
VERSION, PROFILE = b"WARC/1.1", b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = (b"warc-type", b"warc-record-id", b"warc-date", b"content-length")
DATE = b"2024-01-01T00:00:00Z"
ARCHIVE_BYTES, READ_BYTES = 64 << 20, 1 << 20


class WarcError(ValueError):
    """An archive or record that is not as the formats say."""


def _id(page_id: int | None) -> bytes:
    return b"<urn:page:%s>" % (b"null" if page_id is None else str(page_id).encode())


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """The bytes of a response or revisit record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [VERSION, b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Record-ID: " + _id(page_id), b"WARC-Date: " + DATE]
    if url is not None:
        head.append(b"WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~").encode())
    if revisit:
        head += [b"WARC-Profile: " + PROFILE, b"WARC-Refers-To: " + _id(refers_to)]
    head += [b"WARC-Payload-Digest: sha256:" + digest.encode(), b"WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(block).digest()), b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_frame(dictionary: bytes) -> bytes:
    """The leading skippable frame, with the dictionary compressed."""
    body = zstandard.ZstdCompressor().compress(dictionary)
    return DICTIONARY_MAGIC + len(body).to_bytes(4, "little") + body


class _Stream:
    """Bytes of a file, read in parts and put back where a frame ended."""

    def __init__(self, raw):
        self.raw, self.rest, self.at = raw, b"", 0

    def take(self, n: int) -> bytes:
        while len(self.rest) < n and (more := self.raw.read(READ_BYTES)):
            self.rest += more
        got, self.rest = self.rest[:n], self.rest[n:]
        self.at += len(got)
        return got

    def frame(self, decompressor) -> bytes:
        """The content of the frame that starts here."""
        one, out = decompressor.decompressobj(), []
        while not one.eof:
            if not (part := self.take(READ_BYTES if self.rest == b"" else len(self.rest))):
                raise WarcError(f"byte {self.at}: the archive ends within a frame")
            out.append(one.decompress(part))
        self.rest = one.unused_data + self.rest
        self.at -= len(one.unused_data)
        return b"".join(out)


def load_dictionary(stream: _Stream) -> zstandard.ZstdCompressionDict | None:
    """The dictionary of a leading skippable frame, if there is one; leaves the stream at the first record."""
    magic = stream.take(4)
    if magic != DICTIONARY_MAGIC:
        stream.rest, stream.at = magic + stream.rest, 0
        return None
    length = stream.take(4)
    size = int.from_bytes(length, "little")
    body = stream.take(size)
    if len(length) < 4 or len(body) < size:
        raise WarcError("the archive ends within its dictionary")
    if body[:4] == FRAME_MAGIC:
        body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
    return zstandard.ZstdCompressionDict(body) if body else None


def read_archive(raw) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """(headers by lower-case name, block) of each record, validated. raw: a binary file; one record is in memory."""
    stream = _Stream(raw)
    try:
        dictionary = load_dictionary(stream)
        decompressor = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
        while (magic := stream.take(4)) != b"":
            stream.rest = magic + stream.rest
            stream.at -= len(magic)
            if magic != FRAME_MAGIC:
                raise WarcError(f"byte {stream.at}: no frame starts here")
            yield parse_record(stream.frame(decompressor), stream.at)
    except zstandard.ZstdError as e:
        raise WarcError(f"byte {stream.at}: {e}") from e


def parse_record(data: bytes, at: int = 0) -> tuple[dict[bytes, bytes], bytes]:
    """Headers and block of the one record that data holds."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise WarcError(f"before byte {at}: a record's headers don't end")
    version, *lines = data[:end].split(b"\r\n")
    if version not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError(f"before byte {at}: version line {version[:40]!r}")
    headers: dict[bytes, bytes] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"before byte {at}: header line {line[:80]!r}")
        if headers.setdefault(name.lower(), value.strip()) != value.strip() and name.lower() != b"warc-concurrent-to":
            raise WarcError(f"before byte {at}: two values of {name!r}")
    for name in MANDATORY:
        if name not in headers:
            raise WarcError(f"before byte {at}: no header {name!r}")
    if not headers[b"content-length"].isdigit():
        raise WarcError(f"before byte {at}: Content-Length {headers[b'content-length'][:40]!r}")
    length, start = int(headers[b"content-length"]), end + 4
    if len(data) != start + length + 4 or data[-4:] != b"\r\n\r\n":
        raise WarcError(f"before byte {at}: Content-Length is {length}, the frame holds {len(data) - start - 4}")
    block = data[start : start + length]
    digest = headers.get(b"warc-block-digest", b"")
    if digest.startswith(b"sha1:") and digest[5:].upper() != base64.b32encode(hashlib.sha1(block).digest()):
        raise WarcError(f"before byte {at}: the block digest differs")
    return headers, block


def page_of(headers: dict[bytes, bytes], block: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a record of ours, validated."""

    def number(name):
        got = headers.get(name)
        if got is None or not (got.startswith(b"<urn:page:") and got.endswith(b">")):
            raise WarcError(f"{name!r} is {got!r}")
        return None if got == b"<urn:page:null>" else int(got[10:-1])

    kind = headers[b"warc-type"].decode()
    head, gap, payload = block.partition(b"\r\n\r\n")
    told = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    digest = headers.get(b"warc-payload-digest", b"").removeprefix(b"sha256:").decode()
    if not gap or told is None or len(digest) != 64:
        raise WarcError(f"{headers[b'warc-record-id']!r}: no HTTP headers, length or payload digest")
    if kind == "response":
        if told != len(payload) or digest != hashlib.sha256(payload).hexdigest():
            raise WarcError(f"{headers[b'warc-record-id']!r}: the payload differs from its length or digest")
        return number(b"warc-record-id"), told, digest, kind, None
    if kind != "revisit" or payload or headers.get(b"warc-profile") != PROFILE:
        raise WarcError(f"{headers[b'warc-record-id']!r}: type {kind}")
    return number(b"warc-record-id"), told, digest, kind, number(b"warc-refers-to")


def train_dictionary(pages: DataFrame, samples: int = 256, size: int = 16 << 10) -> bytes:
    """A dictionary trained on the starts of at most so many pages, those with the smallest hash; empty if they don't do."""
    pages = pages.select("page_id", F.col("html").cast("string").alias("html"))
    rows = pages.filter("html IS NOT NULL").withColumn("h", F.xxhash64("page_id", "html"))
    last = rows.select("h").orderBy("h").limit(samples).agg(F.max("h").alias("h")).first()["h"]  # only hashes are sorted
    if last is None:
        return b""
    parts = sorted(r["start"].encode() for r in rows.filter(F.col("h") <= last).select(F.substring("html", 1, 8192).alias("start")).limit(samples).collect())
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:  # too few or too small samples
        return b""


def _planned(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(page_id, url, payload, digest, refers_to, revisit). Only digests that occur twice are joined to the pages."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    twice = rows.filter(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    twice = checked_broadcast(Table(twice.select(F.col("digest").alias("seen"), "first", F.lit(True).alias("again")), "warc-twice").df)
    rows = rows.join(twice, rows["digest"] == twice["seen"], "left")
    revisit = F.col("again").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 100) -> DataFrame:
    """Writes pages(page_id, url, html) as archives in folder; gives (path, records, bytes) of each, already written."""
    small_batches(pages.sparkSession)
    dictionary = train_dictionary(pages)

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compressor = zstandard.ZstdCompressor(dict_data=trained) if trained else zstandard.ZstdCompressor()
        out, done, name = None, [], ""
        for b in batches:
            for page_id, url, payload, digest, refers_to, revisit in zip(*(b.column(i).to_pylist() for i in range(6))):
                if out is None:
                    name, records = f"pages-{uuid.uuid4().hex}.warc.zst", 0
                    out = store.open_output_stream(f"{base}/{name}")
                    out.write(dictionary_frame(dictionary) if dictionary else b"")
                out.write(compressor.compress(record(page_id, url, payload, digest, refers_to, revisit)))
                records += 1
                if out.tell() >= ARCHIVE_BYTES:
                    done.append((name, records, out.tell()))
                    out.close()
                    out = None
        if out is not None:
            done.append((name, records, out.tell()))
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n, _, _ in done], pa.string()), pa.array([r for _, r, _ in done], pa.int64()), pa.array([s for _, _, s in done], pa.int64())], ["path", "records", "bytes"])

    return Table(_planned(pages, least_bytes).mapInArrow(run, "path string, records long, bytes long"), "warc-archives").df


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of archives(path); fails on a bad one."""
    n = max(1, min(archives.count(), 100_000))
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def run(batches):
        def arrow(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

        for b in batches:
            for path in b.column("path").to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                rows = []
                with store.open_input_stream(at) as raw:
                    for headers, block in read_archive(raw):
                        rows.append(page_of(headers, block))
                        if len(rows) >= 5000:
                            yield arrow(rows)
                            rows = []
                if rows:
                    yield arrow(rows)

    return archives.select("path").repartition(n).mapInArrow(run, schema)


def round_trip(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Writes pages as archives in the shared folder and reads them back."""
    spark: SparkSession = pages.sparkSession
    folder = f"{shared_root(spark)}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(pages, folder, least_bytes))


#: The same rows for DuckDB.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM d
"""
