"""WARC archives with dictionary compression.

An archive is a .warc.zst: a leading skippable frame (magic 0x184D2A5D) that holds a Zstandard dictionary,
itself compressed, which is built from a bounded sample of the archive's own records; then each record as a
frame of its own. Records of a payload that another page has too are revisits.

Executors make archives of at most ARCHIVE_BYTES of records (one larger record makes one of its own) as rows
of a Parquet table in the shared folder, so Spark's commit protocol covers lost executors and any file
system; export() writes rows out as files.

Defined cases: a null html is the empty payload; payloads under MIN_REVISIT bytes are always responses; pages
that share the smallest page_id of a payload are all responses; a null page_id is never the one referred to; a
null url is an empty header; an empty table makes no archive.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import bounded_batches, table, written

ARCHIVE_BYTES, MIN_REVISIT = 8 << 20, 100
DICTIONARY_MAGIC, DICTIONARY_BYTES, SAMPLE_BYTES, LEVEL = 0x184D2A5D, 16 << 10, 1 << 20, 3
#: WARC-Date of every record, so that archives are the same each time.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def one_line(value: str | None) -> str:
    """A header's value: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """The bytes of a response, or of a revisit of refers_to (its block has the HTTP headers alone)."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    kind = ["WARC-Type: response"] if refers_to is None else ["WARC-Type: revisit", f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    name = "" if page_id is None else page_id
    lines = ["WARC/1.1", *kind, f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Target-URI: {one_line(url)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes]):
    """From records spread over the archive, SAMPLE_BYTES at most and the first in any case; too few for training make a dictionary of raw content."""
    import zstandard

    sample, room = [], SAMPLE_BYTES
    for r in records[:: max(1, sum(map(len, records)) // SAMPLE_BYTES)]:
        if len(r) <= room:
            sample.append(r)
            room -= len(r)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=200, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict((b"".join(sample) or records[0])[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> tuple[bytes, list[int]]:
    """A .warc.zst of the records, and where each record's frame begins."""
    import zstandard

    dictionary = build_dictionary(records)
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary.as_bytes())
    parts, at, offsets = [struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed], 8 + len(packed), []
    compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True, write_content_size=True).compress
    for r in records:
        offsets.append(at)
        parts.append(frame := compress(r))
        at += len(frame)
    return b"".join(parts), offsets


def read_archive(content: bytes) -> Iterator[dict]:
    """The records of a .warc.zst in order: headers (lower-case names), http (headers of the block) and payload."""
    import zstandard

    magic, n = struct.unpack_from("<II", content)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive has no leading dictionary frame")
    packed = content[8 : 8 + n]
    data = zstandard.ZstdDecompressor().decompress(packed) if packed[:4] == b"\x28\xb5\x2f\xfd" else packed
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data)).stream_reader(io.BytesIO(content[8 + n :]), read_across_frames=True)
    stream = io.BufferedReader(reader, 1 << 20)

    def headers() -> dict[str, str]:
        found = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(":")
            found[name.lower()] = value.strip()
        return found

    while first := stream.readline():
        if not first.startswith(b"WARC/1."):
            raise ValueError("a record does not begin with its version")
        head = headers()
        block = stream.read(int(head["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end with two line ends")
        http, _, payload = block.partition(b"\r\n\r\n")
        yield {"headers": head, "http": {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}, "payload": payload}


def payloads(pages: DataFrame) -> DataFrame:
    return pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary").alias("payload"))


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """archive_id, n_records, content (a whole .warc.zst) and offsets, written to the shared folder.

    Digests that several pages have are found by a first pass that moves digests only; if they are few, Spark
    broadcasts them by its own measure of their size, else pages move by digest and a hot digest is split.
    """
    pages = payloads(pages).withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload"))
    again = pages.filter(F.col("n") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("digest", "first_id")
    again = written(again, "again")
    refers = F.when(F.col("n") >= min_revisit, F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")))
    records = pages.join(again, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def made() -> pa.RecordBatch:
            content, offsets = archive(held)
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{n:06d}"]), pa.array([len(held)], type=pa.int64()), pa.array([content], type=pa.binary()), pa.array([offsets], type=pa.list_(pa.int64()))], names=["archive_id", "n_records", "content", "offsets"])

        for batch in batches:
            for page in batch.to_pylist():
                held.append(record(page["page_id"], page["url"], page["payload"], page["digest"], page["refers_to"]))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield made()
                    n, held, size = n + 1, [], 0
        if held:
            yield made()

    return written(records.mapInArrow(run, "archive_id string, n_records long, content binary, offsets array<long>"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record: page_id, url, record_type, refers_to, payload_digest, payload_bytes (both of the full payload) and payload (null for a revisit). A payload that differs from its digest is an error."""
    bounded_batches(archives.sparkSession)
    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def number(urn: str | None) -> int | None:
        return int(urn[10:-1]) if urn and len(urn) > 11 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for r in read_archive(content.as_py()):
                    h, kind, digest = r["headers"], r["headers"]["warc-type"], r["headers"]["warc-payload-digest"].removeprefix("sha256:")
                    if kind == "response" and hashlib.sha256(r["payload"]).hexdigest() != digest:
                        raise ValueError(f"{h['warc-record-id']}: the payload differs from its digest")
                    rows.append((number(h["warc-record-id"]), h["warc-target-uri"], kind, number(h.get("warc-refers-to")), digest, int(r["http"]["content-length"]), r["payload"] if kind == "response" else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return archives.select("content").mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")


def export(archives: DataFrame, folder: str) -> list[str]:
    """Writes each archive as folder/<archive_id>.warc.zst, a folder that the executors share; returns the names. Written under another name first, so a lost executor leaves no half file."""
    import os

    def run(rows):
        for row in rows:
            name = os.path.join(folder, f"{row.archive_id}.warc.zst")
            with open(f"{name}.{TaskContext.get().taskAttemptId()}", "wb") as f:
                f.write(row.content)
            os.replace(f.name, name)

    os.makedirs(folder, exist_ok=True)
    archives.foreachPartition(run)
    return sorted(n for n in os.listdir(folder) if n.endswith(".warc.zst"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = read_archives(write_archives(table(spark, sf_dir, "pages")))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY h)
SELECT p.page_id, p.n AS payload_bytes, p.h AS payload_digest,
  CASE WHEN p.n >= 100 AND p.page_id <> f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.n >= 100 AND p.page_id <> f.first_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON f.h = p.h
"""
