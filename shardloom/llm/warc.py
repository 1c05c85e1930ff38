"""WARC archives with a Zstandard dictionary.

An archive is a byte string of this form: a skippable frame that holds a dictionary, then one frame
for each record, compressed with that dictionary, so that a record can be read by its offset. The
dictionary is built from the archive's own records. Records that repeat a payload are revisits,
which name the record of the smallest page_id and hold no payload.

Archives are rows (archive, content), written by Spark, so any file system that Spark knows will do
and a lost executor's archives are written again; export_files() puts them out as .warc.zst files.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator
from urllib.parse import quote as escape_url
from urllib.parse import unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm.common import need, shared_table
from shardloom.session import ship

# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
FRAME = 0xFD2FB528
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

#: Payload bytes that one archive holds at least before the next begins.
ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 64 << 10
#: A dictionary is built from evenly spaced records of about this many bytes together; it is a model of the records, not a result.
TRAIN_BYTES = 2 << 20
LEVEL = 3
SALTS = 32


def _urn(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _target(url: str | None) -> list[str]:
    """The headers of a target: none for null; one with control characters or outer spaces is escaped as a whole, which a second header says."""
    if url is None:
        return []
    if url == url.strip() and all(c >= " " and c not in "\x7f\x85\u2028\u2029" for c in url):
        return [f"WARC-Target-URI: {url}"]
    return [f"WARC-Target-URI: {escape_url(url, safe='')}", "X-Target-URI-Escaped: yes"]


def record(page_id, url: str | None, payload: bytes, digest: str, first) -> bytes:
    """One WARC record; first is the page_id that a revisit refers to; null or the page's own one for a response."""
    revisit = first is not None and first != page_id
    block = HTTP_HEAD if revisit else HTTP_HEAD + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {DATE}",
        *_target(url),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        *([f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_urn(first)}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def dictionary(records: list[bytes], train_bytes: int = TRAIN_BYTES) -> zstandard.ZstdCompressionDict:
    """A dictionary of records: trained, or, if they are too few or too alike for that, made of whole records as they are."""
    step = max(1, sum(map(len, records)) // train_bytes)
    some = records[::step]
    if len(some) >= 16:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, some)
        except zstandard.ZstdError:
            pass
    raw = b"".join(r for r in some if len(r) <= DICTIONARY_BYTES)
    return zstandard.ZstdCompressionDict(raw[-DICTIONARY_BYTES:] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archive(records: list[bytes], train_bytes: int = TRAIN_BYTES) -> bytes:
    """The archive of some records."""
    words = dictionary(records, train_bytes)
    raw = words.as_bytes()
    squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=True, write_checksum=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(raw)), raw, *map(squeeze.compress, records)])


def read_archive(content: bytes) -> Iterator[bytes]:
    """The records of an archive, in order. ValueError where it isn't of this form."""
    magic, size = struct.unpack_from("<II", content)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame at the start")
    raw = content[8 : 8 + size]
    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    words = zstandard.ZstdCompressionDict(raw, dict_type=kind)
    rest = memoryview(content)[8 + size :]
    while rest:
        if struct.unpack_from("<I", rest)[0] != FRAME:
            raise ValueError("a record's frame is broken")
        take = zstandard.ZstdDecompressor(dict_data=words).decompressobj()
        length = zstandard.frame_content_size(rest)
        out = take.decompress(rest)
        if length not in (-1, len(out)) or not take.eof:
            raise ValueError("a record's frame is cut off")
        yield out
        rest = rest[len(rest) - len(take.unused_data) :]


def parse(rec: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the payload (behind the HTTP head) of a record."""
    head, _, block = rec.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = block[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def write(pages: DataFrame, min_bytes: int = 0, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """Archives (archive string, content binary) of pages (page_id, url, html), written to the shared folder.

    Of pages with equal payloads of at least min_bytes the one with the smallest page_id is the
    response, the others are revisits of it; smaller payloads are all responses. A null html is an
    empty payload; a null url is read back as null. page_id is a whole number; other types raise ValueError.
    A page without page_id is never referred to: it is a revisit where a page with page_id has its payload,
    else a response, however many there are. Rows that repeat page_id and payload are written as
    often as they occur. Other columns are left out, an empty table gives no archive. A payload may have up to 2 GB, as a text column's value.
    train_bytes bounds the records that an archive's dictionary is built from; it changes sizes, not what is read.

    The smallest page_id of a payload is a grouped minimum over digests, not payloads. Payloads that
    occur once need no look-up; the others' pages are spread over SALTS parts of the digest, so that a
    payload of a third of all pages doesn't meet in one task.
    """
    need(pages, "page_id", "url", "html")
    if pages.schema["page_id"].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError("page_id is a whole number")
    ship(pages.sparkSession)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.encode("html", "UTF-8"))).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    large = F.octet_length("html") >= min_bytes
    firsts = rows.where(large).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    firsts = firsts.select("sha", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    told = rows.join(firsts, ["sha", "salt"], "left").withColumn("first", F.when(large, F.col("first")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def out() -> pa.RecordBatch:
            content = write_archive(held, train_bytes)
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(content).hexdigest()[:24] + ".warc.zst"]), pa.array([content], pa.binary())], names=["archive", "content"])

        for batch in batches:
            for page_id, url, html, first in zip(*(batch.column(i).to_pylist() for i in range(4))):
                payload = html.encode("utf-8", "replace")
                held.append(record(page_id, url, payload, sha1_base32(payload), first))
                size += len(payload)
                if size >= ARCHIVE_BYTES:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return shared_table(told.select("page_id", "url", "html", "first").mapInArrow(pack, "archive string, content binary"), "warc")


def read(archives: DataFrame) -> DataFrame:
    """The records of archives (content binary): page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits).

    Digest and length of a response are computed from its payload and must agree with its headers; those of a revisit are the headers'.
    """
    need(archives, "content")
    ship(archives.sparkSession)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        number = lambda urn: int(x) if (x := urn.removeprefix("<urn:page:").removesuffix(">")) else None

        def address(h: dict[str, str]) -> str | None:
            url = h.get("warc-target-uri")
            return unquote(url) if "x-target-uri-escaped" in h else url

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows: list[tuple] = []
                size = 0
                for rec in read_archive(content):
                    h, payload = parse(rec)
                    said = h["warc-payload-digest"].removeprefix("sha1:"), int(h["x-payload-length"])
                    revisit = h["warc-type"] == "revisit"
                    if not revisit and (sha1_base32(payload), len(payload)) != said:
                        raise ValueError(f"record {h['warc-record-id']} is damaged")
                    rows.append((number(h["warc-record-id"]), address(h), said[1], said[0], h["warc-type"], number(h["warc-refers-to"]) if revisit else None, None if revisit else payload))
                    size += len(payload)
                    if size > 4 << 20 or len(rows) >= 2000:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return archives.select("content").mapInArrow(unpack, schema)


def export_files(archives: DataFrame, folder: str) -> int:
    """Write each archive as a file of a folder of the driver's machine, one at a time; how many there are. An export: the archives themselves lie in the shared folder, as Parquet."""
    os.makedirs(folder, exist_ok=True)
    n = 0
    for row in archives.select("archive", "content").toLocalIterator():
        with open(f"{folder}/{row.archive}.part", "wb") as f:
            f.write(row.content)
        os.replace(f"{folder}/{row.archive}.part", f"{folder}/{row.archive}")
        n += 1
    return n


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of .warc.zst files on any file system that Spark reads."""
    return read(spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path))
