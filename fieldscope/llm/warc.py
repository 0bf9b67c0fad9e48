"""WARC records in seekable Zstandard bundles.

Records are grouped into frames that decompress on their own.  A bundle ends in
the seek table of the seekable format (a skippable frame with the two sizes of
each frame), and an index maps each record to its bundle, frame and place within
the decompressed frame, so one record costs one small read.

Records with equal payloads are stored once: the one with the smallest page_id is
the response, the others are revisits that refer to it.

A record's id is its page_id and a number of its row, so rows without a page_id, or that repeat
one, have ids of their own; a revisit refers to one record.  A target URI keeps its escapes; where
it holds what may not stand in a header, that is escaped and the URL as it was stands beside it.

* A NULL payload is an empty one.  Payloads below ``LEAST`` bytes are never revisits.
* Rows that repeat the smallest page_id of a payload are all responses.
* A NULL page_id is never the smallest; rows of a payload without any page_id are responses.
* No rows make no bundles.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from fieldscope.llm import files
from fieldscope.llm.common import kept, new_folder, small_batches

LEAST = 100
FRAME = 1 << 20  # bytes of records after which a frame ends
BUNDLE = 1 << 28  # compressed bytes after which a bundle ends
TASK = 1 << 25  # bytes of records that a task reads
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"  # of pages whose time is not known

# Fixed values of the formats.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_INDEX = "page_id long, record_id string, bundle string, frame int, frame_offset long, place long, length long"
_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def with_responses(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Add ``payload_digest``, ``payload_bytes``, ``row``, a number of the row, and ``first_id`` and ``first_row`` of the response
    to a payload that several rows have.

    Groups are found on digests alone.  They are written first, so the join
    is one whose large keys Spark can deal out to several tasks.  ``pages`` is a
    stored table: rows are numbered by their place in it.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    known = pages.select("page_id", "url", "html").withColumn("payload_digest", F.sha2(payload, 256)).withColumn(
        "payload_bytes", F.octet_length(payload).cast("long")).withColumn("row", F.monotonically_increasing_id())
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row")))
    groups = kept(known.filter(F.col("payload_bytes") >= least).groupBy(F.col("payload_digest").alias("_digest")).agg(
        first.alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(
        "_digest", F.col("_first.page_id").alias("first_id"), F.col("_first.row").alias("first_row")), "payloads")
    return known.join(groups, F.col("payload_digest") == F.col("_digest"), "left").drop("_digest")


def _identifier(page_id: int | None, row: int) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{row:x}>"


def _page_of(identifier: str) -> int | None:
    digits = identifier[len("<urn:page:"):-1].partition(":")[0]
    return int(digits) if digits else None


def _targets(url: str) -> list[tuple[str, str]]:
    """The header of a URL, and one that gives it back where not all of it may stand in a header."""
    safe = re.sub(r"[\x00-\x20\x7f-\x9f\u2028\u2029]", lambda m: quote(m[0]), url)
    return [("WARC-Target-URI", safe)] if safe == url and safe else [("WARC-Target-URI", safe or "urn:none"), ("X-Target-URL", quote(url, safe=""))]


def record(page_id, row, url, payload: bytes, digest: str, size: int, first_id, first_row) -> bytes:
    """One WARC record; a revisit keeps the digest and length of the payload that it leaves out."""
    revisit = first_id is not None and page_id != first_id
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _identifier(page_id, row)),
            ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(size))]
    if url is not None:
        head += _targets(url)
    if revisit:
        head += [("WARC-Profile", _SAME_PAYLOAD), ("WARC-Refers-To", _identifier(first_id, first_row))]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block += b"" if revisit else payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data, place: int = 0) -> tuple[dict, bytes, int]:
    """The headers and payload of the record at a place, and the place after it."""
    top = data.index(b"\r\n\r\n", place)
    head = dict(line.split(": ", 1) for line in data[place:top].decode().split("\r\n")[1:])
    start, size = top + 4, int(head["Content-Length"])
    body = data.index(b"\r\n\r\n", start) + 4
    return head, data[body:start + size], start + size + 4


class BundleWriter:
    """Frames and the seek table of one bundle."""

    def __init__(self, uri: str):
        self.uri, self.out, self.frames, self.at = uri, files.create(uri), [], 0
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)

    def add(self, data: bytes) -> tuple[int, int]:
        """Write one frame; its number and offset."""
        packed, at = self.packer.compress(data), self.at
        self.out.write(packed)
        self.frames.append((len(packed), len(data)))
        self.at += len(packed)
        return len(self.frames) - 1, at

    def close(self) -> None:
        table = b"".join(struct.pack("<II", *f) for f in self.frames)
        foot = struct.pack("<IBI", len(self.frames), 0, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(table) + len(foot)) + table + foot)
        self.out.close()


class BundleReader:
    """Random access to a bundle by its own seek table."""

    def __init__(self, uri: str):
        self.file = files.open_file(uri)
        size = self.file.size()
        self.file.seek(size - 9)
        count, _, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != _SEEKABLE:
            raise ValueError(f"no seek table in {uri}")
        self.file.seek(size - 9 - 8 * count)
        sizes = list(struct.iter_unpack("<II", self.file.read(8 * count)))
        self.frames, at = [], 0
        for packed, full in sizes:
            self.frames.append((at, packed, full))
            at += packed
        self.unpacker = zstandard.ZstdDecompressor()

    def frame(self, number: int) -> bytes:
        at, packed, full = self.frames[number]
        self.file.seek(at)
        return self.unpacker.decompress(self.file.read(packed), max_output_size=full)

    def close(self) -> None:
        self.file.close()


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def write(pages: DataFrame, folder: str, frame: int = FRAME, bundle: int = BUNDLE) -> DataFrame:
    """Write the rows of ``with_responses`` into bundles below ``folder``; the index, one row per record, is a table there.

    Only bundles of tasks that succeeded are in the index.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, waiting, data = None, [], bytearray()

        def flush():
            nonlocal out, waiting, data
            if out is None:
                out = BundleWriter(files.fresh_name(folder, ".warc.zst"))
            number, at = out.add(bytes(data))
            rows = [(page, name, out.uri, number, at, place, length) for page, name, place, length in waiting]
            waiting, data = [], bytearray()
            if out.at >= bundle:
                out.close()
                out = None
            return _batch(rows, _INDEX)

        for batch in batches:
            for row in range(batch.num_rows):
                page, at, url, html, digest, size, first, first_row = (batch.column(i)[row].as_py() for i in range(8))
                made = record(page, at, url, html or b"", digest, size, first, first_row)
                waiting.append((page, _identifier(page, at), len(data), len(made)))
                data += made
                if len(data) >= frame:
                    yield flush()
        if waiting:
            yield flush()
        if out is not None:
            out.close()

    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long"), "row", "url", F.col("html").cast("binary"), "payload_digest",
                        "payload_bytes", F.col("first_id").cast("long"), "first_row")
    rows.mapInArrow(run, _INDEX).write.parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(_INDEX).parquet(f"{folder}/index")


def read(index: DataFrame) -> DataFrame:
    """The records of an index, or of a part of it, from their bundles: only the frames that hold them are read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, bundle, number, data = None, None, None, b""
        for batch in batches:
            rows = []
            for name, frame, place in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if name != uri:
                    if bundle is not None:
                        bundle.close()
                    uri, bundle, number = name, BundleReader(name), None
                if frame != number:
                    number, data = frame, bundle.frame(frame)
                head, payload, _ = parse(data, place)
                digest, size = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["X-Payload-Length"])
                refers = head.get("WARC-Refers-To")
                if refers is None and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"{head['WARC-Record-ID']} in {name} is damaged")
                url = unquote(head["X-Target-URL"]) if "X-Target-URL" in head else head.get("WARC-Target-URI")
                rows.append((_page_of(head["WARC-Record-ID"]), url, size, digest, head["WARC-Type"],
                             None if refers is None else _page_of(refers)))
            yield _batch(rows, _READ)
        if bundle is not None:
            bundle.close()

    # Frames, not bundles, are dealt out, so a large bundle is read by many tasks; their number follows from what the
    # records hold, as index rows alone look small.
    tasks = -(-(index.agg(F.sum("length")).first()[0] or 1) // TASK)
    return index.select("bundle", "frame", "place").repartition(tasks, "bundle", "frame").sortWithinPartitions(
        "bundle", "frame", "place").mapInArrow(run, _READ)


def op1_warc_bundles(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    index = write(with_responses(pages), new_folder(spark, "warc"))
    return read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


WARC_SQL = f"""
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
firsts AS (
  SELECT *, CASE WHEN payload_bytes >= {LEAST} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id
  FROM payloads)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM firsts"""
