"""WARC archives: writing, reading, and revisit resolution.

Archives are WARC/1.0 files with a gzip member for each record, so a reader can start at any record. A
Python step makes the members, from Arrow batches bounded by bytes, and joins them to archives; Spark's
text writer puts each archive's bytes into a file of its own in the shared folder, as they are, so any
store that Spark can write to will hold them. The writer puts something behind each row; here that is an
empty gzip member at an archive's end, which adds nothing to what is read. An archive ends at ``RECORDS_PER_FILE`` records or before it would exceed ``BYTES_PER_FILE`` compressed bytes;
only a single greater record makes a greater archive. Archives are read back through Spark's binary
reader, one member at a time, and blocks are taken by content length, as payloads may hold any bytes.

Revisit resolution reads the headers only as far as digests go: records are shuffled by payload digest,
pre-aggregated to one original per digest and joined back; then each archive is rewritten with fresh
headers, where a record whose payload another record holds becomes a revisit record without payload that
names the original's record id, target and date. Payloads never move by digest; an archive moves once,
compressed, to meet the decisions on it.

Defined results: null payloads count as empty; of equal payloads of at least ``min_bytes`` bytes the
record with the largest id is the original, ties (repeated rows) by the later place in the archives;
null ids come last; each record has an id of its own, also where rows are repeated; urls that are null
have no target header, and line ends in urls are left out; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismark.llm import common

RECORDS_PER_FILE, BYTES_PER_FILE = 1000, 16_000_000
#: Compressed bytes that are read at a time.
CHUNK = 16_384
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def member(data: bytes) -> bytes:
    """A gzip member that holds data."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


EMPTY_MEMBER = member(b"")


def record(headers: list[tuple[str, str | int | None]], block: bytes) -> bytes:
    """The bytes of one record; headers without a value are left out."""
    lines = [f"{name}: {value}" for name, value in [*headers, ("Content-Length", len(block))] if value is not None]
    return b"\r\n".join([b"WARC/1.0", *(x.encode("utf-8", "replace") for x in lines), b"", block, b"", b""])


def write(archives_: DataFrame, path: str) -> None:
    """archives_: data, the bytes of one archive a row."""
    rows = archives_.select(F.col("data").cast("string").alias("value"))
    rows.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("maxRecordsPerFile", 1).text(path)


def _joined(members: Iterator[bytes], records: int, size: int) -> Iterator[pa.RecordBatch]:
    """Archives of members, one to a batch; the next one begins before this one gets too long."""
    row = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(own)], pa.binary())], names=["data"])
    own, held = [], 0
    for data in members:
        if own and (len(own) == records or held + len(data) > size):
            yield row()
            own, held = [], 0
        own.append(data)
        held += len(data)
    if own:
        yield row()


def responses(pages: DataFrame, date: str, records: int = RECORDS_PER_FILE, size: int = BYTES_PER_FILE) -> DataFrame:
    """Archives of pages (page_id, url, payload). Record ids are made from a name of the call, the task and the row's number, so a task that runs again gives the same."""
    call = uuid.uuid4()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def members() -> Iterator[bytes]:
            n = 0
            for b in batches:
                for page, url, payload in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), b.column("payload"), strict=True):
                    name = uuid.uuid5(call, f"{TaskContext.get().partitionId()} {n}")
                    url = None if url is None else url.replace("\r", "").replace("\n", "")
                    block = payload.as_py()
                    yield member(record([
                        ("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", date), ("WARC-Target-URI", url),
                        ("WARC-Payload-Digest", f"sha1:{payload_digest(block)}"), ("X-Page-ID", page), ("Content-Type", "text/html"),
                    ], block))
                    n += 1

        yield from _joined(members(), records, size)

    return pages.select("page_id", "url", "payload").mapInArrow(run, "data binary")


def parsed(content: bytes) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """Headers (names in lower case), block and number of each record of an archive's bytes, compressed or not; one record at a time is in memory."""
    number, place = 0, 0
    packed = content[:2] == b"\x1f\x8b"
    while place < len(content):
        if packed:
            z, read = zlib.decompressobj(31), []
            while not z.eof:
                chunk = content[place : place + CHUNK]
                if not chunk:
                    raise ValueError("a gzip member is cut off")
                read.append(z.decompress(chunk))
                place += len(chunk)
            place -= len(z.unused_data)
            data = b"".join(read)
        else:
            data, place = content, len(content)
        at = 0
        while at < len(data):
            end = data.find(b"\r\n\r\n", at)
            if end < 0 or not data.startswith(b"WARC/", at):
                raise ValueError(f"no WARC record at byte {at}")
            headers = {}
            for h in data[at:end].split(b"\r\n")[1:]:
                name, _, value = h.partition(b":")
                headers[name.decode().strip().lower()] = value.decode("utf-8", "replace").strip()
            size = int(headers["content-length"])
            if not data.startswith(b"\r\n\r\n", end + 4 + size):
                raise ValueError(f"the record at byte {at} has another length than it says")
            yield headers, data[end + 4 : end + 4 + size], number
            at, number = end + 8 + size, number + 1


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _page(headers: dict[str, str]) -> int | None:
    return int(headers["x-page-id"]) if "x-page-id" in headers else None


def archives(spark: SparkSession, path: str) -> DataFrame:
    """The archives under path: at_file, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).select(F.col("path").alias("at_file"), "content")


HEADERS = "page_id bigint, at_file string, number bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, record_id string, url string, date string"


def read_headers(files: DataFrame) -> DataFrame:
    """One row per record; digest and size of a response come from its payload, of a revisit from its headers."""
    names = [x.split()[0] for x in HEADERS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["at_file"], b["content"], strict=True):
                rows = []
                for h, block, number in parsed(content):
                    about = (h["warc-record-id"], h.get("warc-target-uri"), h["warc-date"])
                    kind = h["warc-type"]
                    if kind == "revisit":
                        refers = h.get("x-refers-to-page-id")
                        rows.append((_page(h), name, number, int(h["x-payload-length"]), h["warc-payload-digest"].removeprefix("sha1:"), kind, None if refers is None else int(refers), *about))
                    else:
                        rows.append((_page(h), name, number, len(block), payload_digest(block), kind, None, *about))
                out = pd.DataFrame(rows, columns=names)
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    return files.mapInPandas(run, HEADERS)


def resolve(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The records that become revisits: at_file, number, payload_digest, payload_bytes, refers_to, and the original's record_id, url and date."""
    order = F.struct(F.col("page_id").isNotNull().alias("has_id"), "page_id", "at_file", "number")
    counted = headers.where(F.col("payload_bytes") >= min_bytes)
    original = F.struct(order.alias("o"), "record_id", "url", "date")
    originals = counted.groupBy("payload_digest", "payload_bytes").agg(F.max_by(original, order).alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1")
    key = F.concat_ws(" ", "payload_digest", "payload_bytes").alias("key")
    originals = originals.select(key, "original", "n")
    joined = common.heavy_join(counted.select("at_file", "number", "payload_digest", "payload_bytes", key), originals, "key", "n", headers.count(), ["at_file", "number"])
    copies = joined.where((F.col("at_file") != F.col("original.o.at_file")) | (F.col("number") != F.col("original.o.number")))
    return copies.select("at_file", "number", "payload_digest", "payload_bytes", F.col("original.o.page_id").alias("refers_to"), "original.record_id", "original.url", "original.date")


def rewritten(files: DataFrame, revisits: DataFrame, records: int = RECORDS_PER_FILE, size: int = BYTES_PER_FILE) -> DataFrame:
    """The deduplicated archives, with fresh headers.

    An archive's decisions are at most as many as its records, which the writer bounds.
    """
    one = F.struct("number", "payload_digest", "payload_bytes", "refers_to", "record_id", "url", "date")
    own = revisits.groupBy("at_file").agg(F.collect_list(one).alias("revisits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def members() -> Iterator[bytes]:
            for b in batches:
                for content, decided in zip(b.column("content"), b.column("revisits"), strict=True):
                    by = {r["number"]: r for r in decided.as_py() or []}
                    for h, block, number in parsed(content.as_py()):
                        r = by.get(number)
                        about = [("WARC-Record-ID", h["warc-record-id"]), ("WARC-Date", h["warc-date"]), ("WARC-Target-URI", h.get("warc-target-uri"))]
                        if r is None:
                            more = [("WARC-Type", "response"), *about, ("WARC-Payload-Digest", f"sha1:{payload_digest(block)}")]
                        else:
                            more = [
                                ("WARC-Type", "revisit"), *about, ("WARC-Payload-Digest", f"sha1:{r['payload_digest']}"), ("WARC-Profile", PROFILE),
                                ("WARC-Refers-To", r["record_id"]), ("WARC-Refers-To-Target-URI", r["url"]), ("WARC-Refers-To-Date", r["date"]),
                                ("X-Refers-To-Page-ID", r["refers_to"]), ("X-Payload-Length", r["payload_bytes"]),
                            ]
                        yield member(record([*more, ("X-Page-ID", h.get("x-page-id")), ("Content-Type", "text/html")], b"" if r else block))

        yield from _joined(members(), records, size)

    joined = files.join(own, "at_file", "left").select("content", "revisits")
    return joined.mapInArrow(run, "data binary")


def deduplicated_archives(
    pages: DataFrame, path: str, min_bytes: int = 0, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", records_per_file: int = RECORDS_PER_FILE, bytes_per_file: int = BYTES_PER_FILE
) -> DataFrame:
    """Writes pages to archives, resolves revisits, writes deduplicated archives under path and returns their headers as read back."""
    spark = pages.sparkSession
    common.small_batches(spark)
    payload = F.coalesce(F.col(payload_column).cast("binary"), F.lit(b"")).alias("payload")
    own = pages.select(F.col(id_column).cast("bigint").alias("page_id"), F.col(url_column).alias("url"), payload)
    first = common.scratch(spark, "warc")
    write(responses(own, datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), records_per_file, bytes_per_file), first)
    files = archives(spark, first)
    headers = common.stored(read_headers(files), "warc-headers")
    write(rewritten(files, resolve(headers, min_bytes), records_per_file, bytes_per_file), path)
    common.remove(spark, first)
    return read_headers(archives(spark, path))


def op6_warc_revisits(spark, sf_dir: str) -> DataFrame:
    h = deduplicated_archives(common.table(spark, sf_dir, "pages"), common.scratch(spark, "warc-deduplicated"))
    return h.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
g AS (SELECT t, max(page_id) AS o FROM p GROUP BY t),
h AS (SELECT p.page_id, strlen(p.t) AS payload_bytes, sha1(p.t) AS d, g.o FROM p JOIN g USING (t)),
b AS (SELECT *, list_transform(range(8), lambda k: ('0x' || substr(d, 5 * k + 1, 5))::BIGINT) AS parts FROM h)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((parts[1 + i // 4] >> (5 * (3 - i % 4))) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = o THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = o THEN NULL ELSE o END AS refers_to
FROM b
"""
