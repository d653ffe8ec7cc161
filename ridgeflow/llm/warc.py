"""WARC archives with segmented records and chunked transfer framing.

``write_archives`` writes one record per page through Spark's text writer (any
file system), records of ``SEGMENT`` characters at most: a longer block goes
on in continuation records.  ``read_archives`` reads the files back, groups
continuation records by origin identifier, orders them by segment number,
verifies the total length, decodes the chunked framing, and resolves revisits.

Defined results: a null payload counts as empty.  Of pages with equal payloads
of ``min_bytes`` at least, that with the smallest identifier is a response and
the others revisit it; null identifiers are never referred to and always
responses.  Rows are judged by identifier and payload, so one identifier can
have several payloads.  Repeated rows make a record each, and those that repeat
the smallest identifier are responses too.  An empty table gives no archive and
an empty result.  Only the named columns are read, so
others never clash.  Record sizes and records a file are bounded, so is the
memory to read a file; one payload must fit a task.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, has_files, remove, scratch, slices, table

#: Characters of a record's block at most; with the next value it bounds a file.
SEGMENT = 16_384
RECORDS_PER_FILE = 2_000
#: Characters of a transfer chunk.
CHUNK = 4_096
#: Fixed value: all records carry one date, so that the same input gives the same archive.
DATE = "2024-01-01T00:00:00Z"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_HTTP_REVISIT = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


class BrokenRecord(ValueError):
    """A record that cannot be read as written."""


def chunked(payload: str) -> str:
    """Payload in chunked transfer framing; chunk sizes count UTF-8 bytes."""
    parts = [payload[i : i + CHUNK] for i in range(0, len(payload), CHUNK)]
    return "".join(f"{len(x.encode()):x}\r\n{x}\r\n" for x in parts) + "0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of chunked transfer framing."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise BrokenRecord("chunk size without end")
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise BrokenRecord("chunk is not as long as stated")
        parts.append(body[at : at + size])
        at += size + 2


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(**fields: object) -> str:
    return "WARC/1.1\r\n" + "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items() if v is not None)


def records(page: object, url: str | None, payload: str | None, refers_to: object, salt: int) -> Iterator[str]:
    """The records of one page, without the blank lines that end each."""
    payload = payload or ""
    data = payload.encode()
    name = uuid.UUID(hashlib.md5(f"{page}|{salt}|".encode() + data).hexdigest())
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else None
    block = _HTTP_REVISIT if refers_to is not None else _HTTP + chunked(payload)
    parts = [block[i : i + SEGMENT] for i in range(0, len(block), SEGMENT)]
    for number, part in enumerate(parts, 1):
        first, last = number == 1, number == len(parts) > 1
        yield _header(
            WARC_Type="continuation" if not first else "response" if refers_to is None else "revisit",
            WARC_Record_ID=f"<urn:uuid:{name if first else uuid.uuid5(name, str(number))}>",
            WARC_Date=DATE,
            WARC_Target_URI=url,
            WARC_Segment_Number=number if len(parts) > 1 else None,
            WARC_Segment_Origin_ID=None if first else f"<urn:uuid:{name}>",
            WARC_Segment_Total_Length=len(block.encode()) if last else None,
            WARC_Profile=None if refers_to is None else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            WARC_Payload_Digest=f"sha1:{digest_of(data)}" if first else None,
            X_Page=page if first else None,
            X_Refers_To_Page=refers_to if first else None,
            Content_Type="application/http; msgtype=response" if first else None,
            Content_Length=len(part.encode()),
        ) + "\r\n" + part


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``(page, digest, refers_to)``, once, of the payloads of ``pages(page, digest, size)`` that an earlier identifier has."""
    slim = pages.where(F.col("page").isNotNull() & (F.col("size") >= min_bytes)).select("page", "digest")
    groups = slim.groupBy("digest").agg(F.min("page").alias("refers_to"), F.max("page").alias("last"))
    groups = groups.where("refers_to <> last").drop("last")
    return slim.join(groups, "digest").where("page <> refers_to").distinct()


def write_archives(df: DataFrame, path: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", min_bytes: int = 0) -> None:
    """Write the archives as gzip files below ``path``."""
    pages = bounded_batches(df).select(df[id_column].alias("page"), df[url_column].alias("url"), df[payload_column].alias("payload"))
    data = F.encode(F.coalesce("payload", F.lit("")), "utf-8")
    pages = pages.withColumns({"salt": F.monotonically_increasing_id(), "digest": F.sha1(data), "size": F.octet_length(data)})
    pages = pages.join(revisits(pages, min_bytes), ["page", "digest"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "payload"):
            rows = (x for r in batch.to_pylist() for x in records(**r))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["value"])

    out = pages.select("page", "url", "payload", "refers_to", "salt").mapInArrow(run, "value string")
    out.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and block of each record of an uncompressed archive."""
    at = 0
    while at < len(archive):
        end = archive.find(b"\r\n\r\n", at)
        if end < 0 or not archive.startswith(b"WARC/", at):
            raise BrokenRecord(f"no record at byte {at}")
        lines = archive[at:end].decode().split("\r\n")[1:]
        header = dict(x.split(": ", 1) for x in lines)
        start = end + 4
        stop = start + int(header["Content-Length"])
        if archive[stop : stop + 4] != b"\r\n\r\n":
            raise BrokenRecord(f"record at byte {at} is not as long as stated")
        yield header, archive[start:stop]
        at = stop + 4


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"\r\ntransfer-encoding: chunked" in head.lower() else body


def _parsed(spark: SparkSession, path: str, whole: bool) -> DataFrame:
    """Records that are whole, or else segments, of all archives below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, size = [], 0
                for h, block in parse(gzip.decompress(batch.column(0)[i].as_py())):
                    number = int(h.get("WARC-Segment-Number", 0))
                    if bool(number) == whole:
                        continue
                    own = h.get("WARC-Segment-Origin-ID", h["WARC-Record-ID"])
                    total = h.get("WARC-Segment-Total-Length")
                    rows.append((own, number, total and int(total), h["WARC-Type"], h.get("X-Page"), h.get("X-Refers-To-Page"), h.get("WARC-Payload-Digest", ":").split(":")[1], block))
                    size += len(block)
                    if size > 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, _PARSED)


_PARSED = "origin string, number long, total long, record_type string, page string, refers_to string, digest string, block binary"
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in _PARSED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names)


def _decoded(df: DataFrame) -> DataFrame:
    """``(page, record_type, refers_to, stated, payload)`` of ordered segments or whole records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = []
            for r in batch.select(["number", "total", "record_type", "blocks"]).to_pylist():
                numbers = [x["number"] for x in r["blocks"]]
                block = b"".join(x["block"] for x in r["blocks"])
                if numbers != [0] and (numbers != list(range(1, len(numbers) + 1)) or r["total"] != len(block)):
                    raise BrokenRecord(f"segments {numbers} of {len(block)} bytes, {r['total']} stated")
                payloads.append(payload_of(block) if r["record_type"] == "response" else None)
            keep = [batch.column(batch.schema.get_field_index(n)) for n in ("page", "record_type", "refers_to", "digest")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(payloads, pa.binary())], ["page", "record_type", "refers_to", "stated", "payload"])

    return df.mapInArrow(run, "page string, record_type string, refers_to string, stated string, payload binary")


def read_archives(spark: SparkSession, path: str, id_type: T.DataType | str = "long") -> DataFrame:
    """``(page, record_type, refers_to, stated, payload)`` of every record; a revisit's payload is null."""
    if not has_files(spark, path, "*.gz"):  # there was no page
        schema = "page string, record_type string, refers_to string, stated string, payload binary"
        return spark.createDataFrame([], schema).withColumns({n: F.col(n).cast(id_type) for n in ("page", "refers_to")})
    whole = _parsed(spark, path, True).select("number", "total", "page", "record_type", "refers_to", "digest", F.array(F.struct("number", "block")).alias("blocks"))
    parts = (
        _parsed(spark, path, False)
        .groupBy("origin")
        .agg(
            F.min("number").alias("number"),
            F.max("total").alias("total"),
            *(F.max(F.when(F.col("number") == 1, F.col(n))).alias(n) for n in ("page", "record_type", "refers_to", "digest")),
            F.array_sort(F.collect_list(F.struct("number", "block"))).alias("blocks"),
        )
        .select(whole.columns)
    )
    found = _decoded(whole).unionByName(_decoded(parts))
    return found.withColumns({n: F.col(n).cast(id_type) for n in ("page", "refers_to")})


def digests(df: DataFrame) -> DataFrame:
    """Size and digest of the full payload of each record; a revisit has those of the record that it refers to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = batch.column(4).to_pylist()
            sizes = pa.array([None if x is None else len(x) for x in payloads], pa.int64())
            sums = [None if x is None else digest_of(x) for x in payloads]
            if bad := [s for s, x in zip(batch.column(3).to_pylist(), sums, strict=True) if x and s != x]:
                raise BrokenRecord(f"a payload has not the digest {bad[0]}")
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], sizes, pa.array(sums, pa.string())], ["page", "record_type", "refers_to", "stated", "payload_bytes", "payload_digest"])

    kind = df.schema["page"].dataType
    schema = T.StructType([T.StructField("page", kind), T.StructField("record_type", T.StringType()), T.StructField("refers_to", kind), *T._parse_datatype_string("stated string, payload_bytes long, payload_digest string").fields])
    return df.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op10_warc_segments``: archives of all pages, written, read back and digested."""
    pages = table(spark, sf_dir, "pages")
    path = scratch(spark, "warc")
    write_archives(pages, path)
    found = digests(read_archives(spark, path, pages.schema["page_id"].dataType))
    slim = scratch(spark, "warc-digests")
    found.write.parquet(slim)
    remove(spark, path)
    found = spark.read.parquet(slim)
    responses = found.where("record_type = 'response'")
    of = responses.select(F.col("page").alias("refers_to"), F.col("payload_digest").alias("stated"), "payload_bytes", "payload_digest").dropDuplicates(["refers_to", "stated"])
    again = found.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(of, ["refers_to", "stated"])
    out = responses.unionByName(again)
    return out.select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
x AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS hex, min(page_id) OVER (PARTITION BY h) AS first FROM p),
b AS (SELECT *, array_to_string(list_transform(string_split(hex, ''), lambda c:
          ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', c)]), '') AS bits FROM x)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + substr(bits, (1 + 5 * i)::INT, 5)::BIT::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
"""
