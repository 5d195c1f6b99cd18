"""WARC archives (.warc.zst) with a dictionary of their own in front.

Every archive starts with a skippable frame that holds a Zstandard dictionary made from the records
it is in front of, followed by one Zstandard frame per record. A record can be read alone: skip to
its frame, decompress with the dictionary. Payloads that are equal are archived once: the page with
the smallest id is the response, the others are revisit records that name it.

Pages meet their copies as (digest, id) rows; their text is shuffled once, by page, so a payload
that a third of all pages share is no large group. Archives are closed at ``ARCHIVE_BYTES``.

Defined results: a null payload is empty, and empty payloads are equal like any others; a page
without a url gets its record's id as address; pages without an id are responses and never
referred to; rows that repeat the smallest id and its payload are all responses; an empty table
writes nothing. Only page_id, url and html are read, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from beaconaudit.llm.common import partitions
from beaconaudit.llm.files import write_file
from beaconaudit.operators.store import new_folder, stored

#: Uncompressed bytes after which an archive is closed.
ARCHIVE_BYTES = 16 << 20
#: Size of a dictionary, and how much of its archive's records it is made from at most: every
#: k-th record, so that the whole archive is represented.
DICTIONARY_BYTES = 48 << 10
SAMPLE_BYTES = 1 << 20
LEVEL = 3
#: Equal payloads of at least so many bytes become revisits.
MIN_PAYLOAD = 0
SUFFIX = ".warc.zst"
DATE = "1970-01-01T00:00:00Z"

_SKIPPABLE = 0x184D2A5D
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:x-page:"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<{_ID}{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit with the response's head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {DATE}",
             f"WARC-Target-URI: {quote(url, safe=_URL) if url else _record_id(page_id)[1:-1]}",
             f"WARC-Payload-Digest: sha1:{digest_of(payload)}", "Content-Type: application/http;msgtype=response"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_URL = "!#$%&'()*+,/:;=?@[]~-._"


def archive(records: list[bytes]) -> list[bytes]:
    """The frames of an archive: the dictionary's and each record's.

    Records that are too few or too equal to train on are a dictionary of raw content themselves.
    """
    total = sum(map(len, records))
    sample, size = [], 0
    for r in records[::max(1, -(-total // SAMPLE_BYTES))]:
        if size >= SAMPLE_BYTES:
            break
        sample.append(r[:SAMPLE_BYTES - size])
        size += len(sample[-1])
    try:
        trained = zstandard.train_dictionary(min(DICTIONARY_BYTES, size // 8), sample, k=400, d=8) if len(sample) >= 8 else None
    except zstandard.ZstdError:
        trained = None
    if trained is None:
        trained = zstandard.ZstdCompressionDict(b"".join(sample)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained)
    raw = zstandard.ZstdCompressor(level=LEVEL).compress(trained.as_bytes())
    return [struct.pack("<II", _SKIPPABLE, len(raw)) + raw, *(packer.compress(r) for r in records)]


def _frame_end(data: bytes, at: int) -> int:
    """Where the Zstandard frame that starts at ``at`` ends: its header, its blocks, its checksum."""
    checksum = data[at + 4] >> 2 & 1
    at += zstandard.frame_header_size(data[at:at + 18])
    while True:
        block = int.from_bytes(data[at:at + 3], "little")
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            return at + 4 * checksum


def records(data: bytes) -> Iterator[bytes]:
    """The records of an archive."""
    at, trained = 0, None
    while at < len(data) and struct.unpack_from("<I", data, at)[0] & 0xFFFFFFF0 == 0x184D2A50:
        magic, size = struct.unpack_from("<II", data, at)
        if magic == _SKIPPABLE:
            raw = data[at + 8:at + 8 + size]
            packed = raw[:4] == b"\x28\xb5\x2f\xfd"
            trained = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw) if packed else raw)
        at += 8 + size
    unpacker = zstandard.ZstdDecompressor(dict_data=trained) if trained else zstandard.ZstdDecompressor()
    while at < len(data):
        end = _frame_end(data, at)
        yield unpacker.decompress(data[at:end])
        at = end


def parse(raw: bytes) -> dict:
    """What a record says; a payload that is not its digest's is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != length or digest_of(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")

    def number(name: str) -> int | None:
        text = fields.get(name, "<>")[1:-1].removeprefix(_ID)
        return int(text) if text else None

    return {"page_id": number("WARC-Record-ID"), "payload_bytes": length, "payload_digest": digest,
            "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To")}


def revisits(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload an earlier id has already."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.where("page_id IS NOT NULL").select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"))
    rows = stored(rows.where(F.col("size") >= min_payload).drop("size"))
    first = (rows.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"))
             .where("refers_to < last").drop("last"))
    return rows.join(first, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


def write(pages: DataFrame, folder: str, min_payload: int = MIN_PAYLOAD, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives into ``folder``; returns their list: name, n_records, n_bytes."""
    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            name, frames = f"{part:07d}-{number:07d}{SUFFIX}", archive(held)
            write_file(f"{folder}/{name}", frames)
            return pa.RecordBatch.from_pylist([{"name": name, "n_records": len(held), "n_bytes": sum(map(len, frames))}])

        for batch in batches:
            for page_id, url, html, other in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                held.append(record(page_id, url, html, other))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close()
                    held, size, number = [], 0, number + 1
        if held:
            yield close()

    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("html")).withColumn("digest", F.sha1("html"))
    # by page, not by payload; the order makes another attempt of a task write the same files
    rows = (rows.repartition(partitions(pages.sparkSession), "page_id", "digest")
            .join(revisits(pages, min_payload), ["page_id", "digest"], "left")
            .sortWithinPartitions("page_id", "digest", "url").select("page_id", "url", "html", "refers_to"))
    return stored(rows.mapInArrow(archives, "name string, n_records long, n_bytes long"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Per record of the archives in ``folder``: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    kinds = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                       ("record_type", pa.string()), ("refers_to", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                yield pa.RecordBatch.from_pylist([parse(r) for r in records(batch["content"][i].as_py())], schema=kinds)

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"[0-9]*{SUFFIX}").load(folder).select("content")
    return files.mapInArrow(rows, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Archives the pages and describes them from the archives alone."""
    spark = pages.sparkSession
    folder = new_folder(spark)
    if write(pages, folder, min_payload).isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read(spark, folder)


#: DuckDB has no base 32: five hexadecimal digits are four letters.
ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS h, min(page_id) OVER (PARTITION BY sha1(payload)) AS first FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
         (CAST('0x' || substr(h || '000', 1 + (5 * i) // 4, 3) AS INT) >> (7 - (5 * i) % 4)) & 31 AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
