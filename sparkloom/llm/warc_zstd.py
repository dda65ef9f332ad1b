"""WARC archives compressed with Zstandard and a shared dictionary.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary; each record follows as a
frame of its own, so that records can be read one by one. Spark writes the archives: every frame is a row of a
text sink whose line separator is an empty skippable frame, which readers skip. Reading takes any Hadoop path:
each archive is loaded by Spark, its dictionary taken from the leading frame, and record after record decoded,
with headers and lengths validated.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import arrow_map, discard_path, scratch, stored

DICT_MAGIC = struct.pack("<I", 0x184D2A5D)
#: An empty skippable frame (magic 0x184D2A50), which separates the frames of an archive.
SEPARATOR = struct.pack("<II", 0x184D2A50, 0).decode("latin-1")
FRAME_MAGIC = struct.pack("<I", 0xFD2FB528)
#: Bytes of payload that an archive holds on average, and the sample that the dictionary is trained on.
ARCHIVE_BYTES = 16 << 20
DICT_SAMPLE, DICT_SAMPLE_BYTES, DICT_BYTES = 400, 16 << 10, 64 << 10
REQUIRED = (b"warc-type", b"warc-record-id", b"warc-date", b"content-length")
DATE = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive or record that isn't valid."""


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A Zstandard dictionary; the raw samples where they are too few to train on."""
    samples = [s[:DICT_SAMPLE_BYTES] for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def record(kind: str, record_id: str, uri: str, payload: bytes, digest: str, refers_to: str | None = None, page_id: int | None = None) -> bytes:
    """A response or revisit record; the block is the payload, empty for a revisit."""
    block = b"" if kind == "revisit" else payload
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Payload-Length", str(len(payload)))]
        if refers_to is not None:
            head.append(("WARC-Refers-To", f"<{refers_to}>"))
    head += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[bytes, bytes], bytes]:
    """(headers by lower-case name, block) of one record; raises WarcError unless headers and length are right."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/1."):
        raise WarcError("no WARC header")
    fields: dict[bytes, bytes] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise WarcError(f"bad header line {line[:60]!r}")
        fields[name.strip().lower()] = value.strip()
    if missing := [n for n in REQUIRED if n not in fields]:
        raise WarcError(f"missing {missing}")
    if not fields[b"content-length"].isdigit():
        raise WarcError("bad Content-Length")
    length = int(fields[b"content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length {length}, block of {len(rest) - 4} bytes")
    block = rest[:length]
    digest = fields.get(b"warc-payload-digest", b"")
    if fields[b"warc-type"] == b"response" and digest.startswith(b"sha1:") and digest[5:] != base64.b32encode(hashlib.sha1(block).digest()):
        raise WarcError("payload digest differs")
    return fields, block


def read_archive(content: bytes | memoryview) -> Iterator[bytes]:
    """The records of an archive, one decoded frame each; raises WarcError if a frame is cut off or missing."""
    view = memoryview(content)
    if len(view) < 8 or view[:4] != DICT_MAGIC:
        raise WarcError("no dictionary frame")
    size = struct.unpack("<I", view[4:8])[0]
    at = 8 + size
    if at > len(view):
        raise WarcError("dictionary frame is cut off")
    raw = bytes(view[8:at])
    if raw[:4] == FRAME_MAGIC:
        raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 24)
    zdict = zstandard.ZstdCompressionDict(raw) if raw else None
    reader = zstandard.ZstdDecompressor(dict_data=zdict) if zdict else zstandard.ZstdDecompressor()
    while at < len(view):
        magic = bytes(view[at : at + 4])
        if len(view) - at >= 8 and magic[1:] == b"\x2a\x4d\x18" and 0x50 <= magic[0] <= 0x5F:
            at += 8 + struct.unpack("<I", view[at + 4 : at + 8])[0]
            continue
        if magic != FRAME_MAGIC:
            raise WarcError(f"no frame at byte {at}")
        frame, parts, step = reader.decompressobj(), [], 1 << 14
        while not frame.eof:
            if at >= len(view):
                raise WarcError("frame is cut off")
            chunk = view[at : at + step]
            parts.append(frame.decompress(chunk))
            at += len(chunk) - (len(frame.unused_data) if frame.eof else 0)
            step = min(step * 2, 1 << 20)
        yield b"".join(parts)


def _sha1_base32(hexed: str) -> str:
    return base64.b32encode(bytes.fromhex(hexed)).decode()


def record_id(page_id: int | None, row: int) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"page/{page_id}" if page_id is not None else f"row/{row}").urn


def plan_records(pages: DataFrame, archives: int, min_revisit_bytes: int = 0) -> DataFrame:
    """``pages`` with payload, sha1 (hex), payload_bytes and, for revisits, response_id: the smallest page_id with
    an equal payload of at least ``min_revisit_bytes`` bytes. Rows are dealt evenly to ``archives`` partitions.

    Equal payloads are found on digests alone; payloads are shuffled once, by row, so a payload that a third of
    all pages share is spread over all archives."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")}).withColumn("_k", F.xxhash64("page_id", "sha1"))
    small = rows.select("page_id", "sha1", "payload_bytes", "_k").filter(F.col("payload_bytes") >= min_revisit_bytes)
    groups = small.groupBy("sha1", "payload_bytes").agg(F.min("page_id").alias("response_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    revisits = small.join(groups, ["sha1", "payload_bytes"]).filter("not (page_id <=> response_id)").select("_k", "response_id").distinct()
    return rows.repartition(archives, "_k").join(revisits.repartition(archives, "_k"), "_k", "left")


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0) -> None:
    """Write one record per row of ``pages`` (page_id, url, html) to archives in the folder ``path``."""
    keyed = pages.withColumn("_k", F.xxhash64("page_id"))
    smallest = keyed.select("_k").orderBy("_k").limit(DICT_SAMPLE).agg(F.max("_k")).first()[0]
    picked = keyed.filter(F.col("_k") <= smallest).select(F.substring(F.coalesce("html", F.lit("")), 1, DICT_SAMPLE_BYTES).alias("h"))
    sample = [r["h"].encode() for r in picked.limit(DICT_SAMPLE).collect()] if smallest is not None else []
    dictionary = train_dictionary(sample)
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    archives = max(1, -(-int(total) // ARCHIVE_BYTES))

    def frames(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zdict = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        writer = zstandard.ZstdCompressor(level=3, dict_data=zdict, write_content_size=True) if zdict else zstandard.ZstdCompressor(level=3)
        head = DICT_MAGIC + struct.pack("<I", len(dictionary)) + dictionary
        for batch in it:
            out = [head] if head else []
            head = b""
            for page, url, payload, sha1, response, row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha1", "response_id", "_row"))):
                revisit = response is not None
                uri = "".join(c for c in (url or "urn:none") if c >= " ")
                out.append(
                    writer.compress(
                        record("revisit" if revisit else "response", record_id(page, row), uri, payload.encode(), _sha1_base32(sha1), record_id(response, 0) if revisit else None, page)
                    )
                )
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    rows = plan_records(pages, archives, min_revisit_bytes).withColumn("_row", F.monotonically_increasing_id())
    arrow_map(rows.select("page_id", "url", "payload", "sha1", "response_id", "_row"), frames, "frame binary").select(F.col("frame").cast("string")).write.option("lineSep", SEPARATOR).text(path)


def read_archives(spark, path: str) -> DataFrame:
    """The records in the archives below ``path``: record_id, record_type, uri, page_id, payload_digest,
    payload_bytes, refers_to_id, payload (null for revisits), archive. Invalid archives fail the read."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                if not len(content.as_buffer()):
                    continue
                rows: list[tuple] = []
                held = 0
                for raw in read_archive(memoryview(content.as_buffer())):
                    h, block = parse_record(raw)
                    kind = h[b"warc-type"].decode()
                    clean = lambda x: None if x is None else x.decode().strip("<>")
                    page = h.get(b"x-page-id")
                    size = int(h.get(b"x-payload-length", b"0")) if kind == "revisit" else len(block)
                    rows.append((clean(h[b"warc-record-id"]), kind, clean(h.get(b"warc-target-uri")), None if page is None else int(page), h.get(b"warc-payload-digest", b"sha1:").decode()[5:], size, clean(h.get(b"warc-refers-to")), None if kind == "revisit" else block.decode(errors="replace"), name))
                    held += len(block)
                    if held > 4 << 20:
                        yield _table(rows)
                        rows, held = [], 0
                if rows:
                    yield _table(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return arrow_map(files, run, "record_id string, record_type string, uri string, page_id long, payload_digest string, payload_bytes long, refers_to_id string, payload string, archive string")


_NAMES = ("record_id", "record_type", "uri", "page_id", "payload_digest", "payload_bytes", "refers_to_id", "payload", "archive")


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], list(_NAMES))


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write and read back every row of ``pages``: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Of equal payloads of at least ``min_revisit_bytes`` bytes the record with the smallest page_id is the response
    and the others revisit it; rows repeated with that page_id are responses too. Null html is an empty payload. A
    row without page_id revisits its group's smallest page_id; without such it is a response. Very long payloads are
    records like others; an empty table gives an empty result; other columns are ignored, whatever their names. The
    archives are deleted once they are read: :func:`write_archives` keeps them.
    """
    path = scratch(pages.sparkSession)
    write_archives(pages, path, min_revisit_bytes)
    read = read_archives(pages.sparkSession, path).drop("payload")
    read = stored(read)
    discard_path(pages.sparkSession, path)
    ids = read.filter("record_type = 'response' and page_id is not null").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")).distinct()
    revisits = read.filter("record_type = 'revisit'").join(ids, "refers_to_id", "left")
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return read.filter("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long")).select(*cols).unionByName(revisits.select(*cols))
