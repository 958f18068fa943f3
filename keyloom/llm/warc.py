"""WARC as a content-addressed archive.

Payload bytes are stored once under their SHA-256, verified by length and SHA-1; record
headers are stored apart, byte for byte.  A record is reconstructed by joining its headers
with its payload.  Of the pages with one payload, that of the smallest page_id is written
as a response and the others as revisits of it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace

#: Payloads of fewer bytes are all written as responses.
LEAST_REVISITED = 0
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: four groups of 40 bits, eight digits each."""
    digits = F.sha1(payload)
    group = lambda i: F.lpad(F.conv(F.substring(digits, 1 + 10 * i, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*(group(i) for i in range(4))), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _line(text: Column) -> Column:
    """A header value on one line."""
    return F.replace(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


@dataclass
class Archive:
    """payloads: (sha256, payload, payload_bytes, sha1); headers: (page_id, sha256, record_type, headers)."""

    payloads: DataFrame
    headers: DataFrame


def write_archive(pages: DataFrame, work: Workspace, least: int = LEAST_REVISITED) -> Archive:
    """Writes a WARC record for each row of ``pages`` (page_id, url, html).

    Null html is an empty payload, a null url an empty one, line breaks in urls are
    percent-encoded.  Null page_ids never are the smallest; payloads that only they have
    are responses.  Rows that repeat the smallest page_id are responses too, of one stored
    payload.  Other columns are ignored.  Two payloads of one SHA-256 but different length
    or SHA-1 raise an error instead of being taken for one.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), payload.alias("payload"))
    facts = rows.select("page_id", "url", "payload", F.unhex(F.sha2("payload", 256)).alias("sha256"), F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("sha1"))
    # Copies are folded before the shuffle, so a payload that many pages share is sent once by a task.
    one = facts.groupBy("sha256").agg(F.min("payload").alias("payload"), F.min("payload_bytes").alias("payload_bytes"), F.min("sha1").alias("sha1"), F.max("payload_bytes").alias("most"), F.max("sha1").alias("last"), F.min("page_id").alias("first_page"))
    sound = one.withColumn("payload_bytes", F.when((F.col("most") == F.col("payload_bytes")) & (F.col("last") == F.col("sha1")), F.col("payload_bytes")).otherwise(F.raise_error(F.lit("two payloads share a digest")).cast("long")))
    payloads = work.write(sound.select("sha256", "payload", "payload_bytes", "sha1", "first_page"), "payloads")

    known = payloads.select("sha256", "payload_bytes", "sha1", "first_page")
    slim = rows.select("page_id", "url", F.unhex(F.sha2("payload", 256)).alias("sha256")).join(known, "sha256")
    again = (F.col("payload_bytes") >= least) & F.col("first_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    common = F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id")), F.lit(f"{CRLF}WARC-Date: {DATE}{CRLF}WARC-Target-URI: "), _line(F.col("url")), F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("sha1"), F.lit(f"{CRLF}Content-Type: application/http;msgtype=response{CRLF}"))
    size = F.octet_length(http.cast("binary"))
    response = F.concat(F.lit(f"WARC/1.1{CRLF}WARC-Type: response{CRLF}"), common, F.lit("Content-Length: "), (size + F.col("payload_bytes")).cast("string"), F.lit(CRLF + CRLF), http)
    revisit = F.concat(F.lit(f"WARC/1.1{CRLF}WARC-Type: revisit{CRLF}WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: "), _record_id(F.col("first_page")), F.lit(CRLF), common, F.lit("Content-Length: "), size.cast("string"), F.lit(CRLF + CRLF), http)
    headers = work.write(slim.select("page_id", "sha256", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, revisit).otherwise(response).cast("binary").alias("headers")), "headers")
    return Archive(payloads, headers)


def reconstruct(archive: Archive) -> DataFrame:
    """(page_id, sha256, record): the bytes of every WARC record as it would stand in a file; a revisit has no payload of its own."""
    ends = F.lit(CRLF + CRLF).cast("binary")
    revisits = archive.headers.where("record_type = 'revisit'").select("page_id", "sha256", F.concat("headers", ends).alias("record"))
    responses = archive.headers.where("record_type = 'response'").join(archive.payloads.select("sha256", "payload"), "sha256").select("page_id", "sha256", F.concat("headers", "payload", ends).alias("record"))
    return responses.unionByName(revisits)


_READ = "page_id long, sha256 binary, record_type string, refers_to long, payload_bytes long, payload_digest string, sound boolean"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """A record's named fields, and its HTTP payload; raises ValueError unless it is exactly one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split(CRLF)
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    n = int(fields["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    return fields, rest[:n].partition(b"\r\n\r\n")[2]


def _page(urn: str | None) -> int | None:
    return int(urn[10:-1]) if urn and len(urn) > 11 else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _READ.split(", ")]
    for batch in batches:
        rows = []
        for sha256, record in zip(batch.column("sha256"), batch.column("record"), strict=True):
            fields, payload = parse_record(record.as_py())
            kind = fields["WARC-Type"]
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            sound = kind == "revisit" or (fields["WARC-Payload-Digest"] == f"sha1:{digest}" and hashlib.sha256(payload).digest() == sha256.as_py())
            rows.append((_page(fields["WARC-Record-ID"]), sha256.as_py(), kind, _page(fields.get("WARC-Refers-To")), len(payload), digest, sound))
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        types = (pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def read_archive(archive: Archive, work: Workspace) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record, parsed from its reconstructed bytes.

    Digests are computed from the bytes and held against those in the headers and the
    store; a difference raises an error.  A revisit's payload is that of the record it
    refers to.
    """
    read = work.write(reconstruct(archive).mapInArrow(_read, _READ), "read")
    checked = read.withColumn("payload_bytes", F.when(F.col("sound"), F.col("payload_bytes")).otherwise(F.raise_error(F.lit("a record's payload doesn't match its digest")).cast("long")))
    responses = checked.where("record_type = 'response'")
    payload_of = responses.groupBy("sha256").agg(F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest"))
    revisits = checked.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(payload_of, "sha256")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.select(*columns).unionByName(revisits.select(*columns))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "warc")
    return read_archive(write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), work), work)
