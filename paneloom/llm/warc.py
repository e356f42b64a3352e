"""WARC archives with revisit records for payloads that were written already."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paneloom.llm.common import shared_dir, short_batches, slices, written

CRLF = "\r\n"
HTTP = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"
#: Fixed values of the WARC 1.1 format.
VERSION, END = "WARC/1.1", CRLF + CRLF
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: A gzip member of nothing, which Spark's text writer puts between the members of records.
NOTHING = gzip.compress(b"", mtime=0)
#: Bytes of a file at most, but for a longer record, and of a batch of records.
FILE_BYTES, READ_BYTES = 64 << 20, 4 << 20


def digest_base32(payload: Column) -> Column:
    """SHA-1 in base 32, upper case: each 40 bits are 10 hex digits or 8 of base 32."""
    hexes = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexes, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def named(*parts: Column) -> Column:
    """A digest of values and nulls, each with its own, so that no two lists of parts are alike."""
    return F.md5(F.concat(*[F.md5(F.coalesce(F.concat(F.lit("v"), p.cast("string")), F.lit("-"))) for p in parts]))


def resolved(pages: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """One row for each record: page_id, url, payload_digest, payload_bytes, html, record_type, refers_to, copy.

    Headers alone are shuffled by digest. Of equal payloads of at least min_bytes, the row
    with the largest page_id is the response (then the largest url; nulls are least), the
    others revisit it. Payloads move once, by page and digest, whatever the size of a
    group of equal ones. A null html is an empty payload. Rows that repeat are records
    each; all but one, numbered by copy, are revisits. Other columns are left out.
    """
    payload = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", "url", payload.alias("html"), digest_base32(payload.cast("binary")).alias("payload_digest"))
    key = ["page_id", "url", "payload_digest"]
    # One key without nulls, so that grouping and join shuffle by the same and payloads move once.
    pages = pages.withColumn("key", named(*map(F.col, key)))
    headers = pages.groupBy("key").agg(*[F.first(k).alias(k) for k in key], F.first(F.octet_length("html")).cast("long").alias("payload_bytes"), F.count("*").alias("n"))
    # As a table it joins the headers of a very frequent payload in parts.
    best = written(headers.groupBy("payload_digest").agg(F.max(F.struct("page_id", "url", "key")).alias("first")), "first-payloads")
    decided = headers.join(best, "payload_digest").select(
        "key", *key, "payload_bytes", "n", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"), (F.col("first.key") == F.col("key")).alias("is_first")
    )
    bodies = pages.groupBy("key").agg(F.first("html").alias("html"))
    rows = bodies.join(decided, "key").select(*key, "html", "payload_bytes", "first_id", "first_url", "is_first", F.explode(F.expr("sequence(1L, n)")).alias("copy"))
    whole = (F.col("payload_bytes") < min_bytes) | (F.col("is_first") & (F.col("copy") == 1))
    return rows.select(
        *key,
        "payload_bytes",
        F.when(whole, F.col("html")).alias("html"),
        F.when(whole, "response").otherwise("revisit").alias("record_type"),
        F.when(~whole, F.col("first_id")).alias("refers_to"),
        F.when(~whole, F.col("first_url")).alias("refers_to_url"),
        "copy",
    )


def record(date: Column) -> Column:
    """A record's header and block; the next record follows after two line ends."""

    def urn(*of: str, copy: Column) -> Column:
        h = named(*map(F.col, of), copy)
        cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
        return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))

    def line(name: str, value: Column) -> Column:
        return F.when(value.isNull(), "").otherwise(F.concat(F.lit(name + ": "), value, F.lit(CRLF)))

    def uri(name: str) -> Column:
        return F.regexp_replace(name, r"[\x00-\x20\x7F]", "%20")

    whole = F.col("record_type") == "response"
    block = F.when(whole, F.concat(F.lit(HTTP), "html")).otherwise(F.lit(HTTP))
    return F.concat(
        F.lit(VERSION + CRLF),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", urn("page_id", "url", "payload_digest", copy=F.col("copy"))),
        line("WARC-Date", date),
        line("WARC-Target-URI", uri("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        line("WARC-Profile", F.when(~whole, PROFILE)),
        line("WARC-Refers-To", F.when(~whole, urn("refers_to", "refers_to_url", "payload_digest", copy=F.lit(1)))),
        line("WARC-Refers-To-Target-URI", uri("refers_to_url")),
        line("X-Page-Id", F.col("page_id").cast("string")),
        line("X-Refers-To-Page-Id", F.col("refers_to").cast("string")),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
        block,
    )


def write_archives(pages: DataFrame, path: str, *, min_bytes: int = 0, date: str | None = None, file_bytes: int = FILE_BYTES) -> None:
    """Writes pages as WARC files under path, each record a gzip member of its own.

    A file ends before a record that would take it over file_bytes. Spark's text writer
    makes the files, so they are committed like any output; between records it writes an
    empty member, which holds nothing.
    """

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size = 0, 0
        for batch in batches:
            for few in slices([batch], 256):
                members, parts = [gzip.compress(raw, mtime=0) for raw in few.column(0).to_pylist()], []
                for member in members:
                    if size and size + len(member) + len(NOTHING) > file_bytes:
                        part, size = part + 1, 0
                    size += len(member) + len(NOTHING)
                    parts.append(part)
                yield pa.record_batch({"part": pa.array(parts, pa.int32()), "value": pa.array(members, pa.binary())})

    short_batches(pages.sparkSession)
    when = F.lit(date) if date else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    records = resolved(pages, min_bytes=min_bytes).select(F.concat(record(when), F.lit(END)).cast("binary").alias("value"))
    members = records.mapInArrow(compress, "part int, value binary").withColumn("value", F.col("value").cast("string"))
    members.write.partitionBy("part").option("encoding", "ISO-8859-1").option("lineSep", NOTHING.decode("latin-1")).option("compression", "none").text(path)


def members(data: bytes) -> Iterator[bytes]:
    """What each gzip member of a file holds, one at a time; empty ones are left out."""
    at, view = 0, memoryview(data)
    while at < len(data):
        one, out = zlib.decompressobj(wbits=31), []
        while not one.eof:
            chunk = view[at : at + (1 << 16)]
            if not len(chunk):
                raise ValueError("the last member is not whole")
            out.append(one.decompress(chunk))
            at += len(chunk) - len(one.unused_data)
        if found := b"".join(out):
            yield found


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive."""
    at = 0
    while at < len(data):
        body = data.index(b"\r\n\r\n", at) + 4
        head = data[at : body - 4].decode("utf-8", "replace").split(CRLF)
        if head[0] != VERSION:
            raise ValueError(f"no record at byte {at}")
        fields = dict(x.split(": ", 1) for x in head[1:])
        end = body + int(fields["Content-Length"])
        yield fields, data[body:end]
        if data[end : end + 4] != END.encode():
            raise ValueError(f"record at byte {at} has another length than it says")
        at = end + 4


def read_archives(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest and payload of each record.

    Length and digest are those of the payload that was read; a revisit, which has none,
    has those of its header. payload is null for revisits. A task holds one file as it is
    on disk and a batch of records; a member with several records is read too.
    """

    kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def told() -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                for member in members(batch.column(0)[i].as_py()):
                    for fields, block in parsed(member):
                        payload = block.split(END.encode(), 1)[1] if fields["WARC-Type"] == "response" else None
                        size = int(fields["X-Payload-Length"]) if payload is None else len(payload)
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:") if payload is None else base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        rows.append((fields.get("X-Page-Id"), fields.get("WARC-Target-URI"), fields["WARC-Type"], fields.get("X-Refers-To-Page-Id"), size, digest, payload))
                        held += len(block)
                        if held > READ_BYTES or len(rows) == 1000:
                            yield told()
                            rows, held = [], 0
        yield told()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("content")
    found = files.mapInArrow(read, "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary")
    return found.withColumns({"page_id": F.col("page_id").cast(id_type), "refers_to": F.col("refers_to").cast(id_type)})


def round_trip(pages: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """Writes archives in the shared folder and reads them back."""
    path = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, min_bytes=min_bytes)
    return read_archives(pages.sparkSession, path, pages.schema["page_id"].dataType.simpleString())
