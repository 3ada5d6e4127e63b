"""Op 5, WARC: archives of request, response or revisit, and metadata records, and the assembly of their transactions.

Each record is a gzip member of its own. Writing needs no file access from Python: an archive of about `archive_bytes`
is one value, and Spark's text writer puts each value into its own file. The writer ends a value with a line separator; it
is the zero byte that the last member of an archive lacks, an empty member's, so the file is nothing but members.
Reading takes archives as binary files, walks their members, and brings the records of a capture together by
WARC-Concurrent-To in one shuffle.

Defined results: a null html is an empty payload, a null url an empty target. Rows that repeat a page whole are one
capture. Of two rows with one page_id and different contents each is a capture of its own. An empty table makes no
archive and no capture. Control characters of a url are percent-encoded in the header."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Kept

REVISIT_FROM = 1000
#: Compressed bytes of an archive, about, and zlib's level.
ARCHIVE_BYTES, LEVEL = 32_000_000, 1
#: Bytes that a member is read by.
WINDOW = 16_384
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "file string, at long, type string, record_id string, concurrent_to string, refers_to string, target_uri string, page_id long, payload_bytes long, payload_digest string, payload string"


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = REVISIT_FROM) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, capture, refers_to): refers_to is the capture with the largest id among equal payloads."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1(F.encode("payload", "utf-8")))
    one = F.md5(F.concat_ws("\0", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "url", "payload_digest"))
    rows = rows.withColumn("capture", F.concat(F.lit("<urn:uuid:"), *[x for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(one, i, n), F.lit("-" if i < 21 else ">"))]))
    holders = (
        rows.where(F.col("payload_bytes") >= least)
        .groupBy("payload_digest")
        .agg(F.max(F.struct("page_id", "capture")).alias("holder"), F.count("*").alias("n"))
        .where("n > 1")
        .select("payload_digest", F.col("holder.capture").alias("held_by"))
    )
    rows = rows.join(holders, "payload_digest", "left")
    return rows.withColumn("refers_to", F.when(F.col("held_by") != F.col("capture"), F.col("held_by"))).drop("held_by")


def members(batches: Iterator[pa.RecordBatch], archive_bytes: int) -> Iterator[pa.RecordBatch]:
    """Archives of (records) strings: a member for each, then an empty member without its last byte, which is zero."""
    held, size = [], 0
    end = gzipped(b"")[:-1]

    def archive() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join([*held, end])], pa.binary())], ["value"])

    for batch in batches:
        for record in batch.column(0):
            held.append(gzipped(record.as_py().encode() + b"\r\n\r\n"))
            size += len(held[-1])
            if size >= archive_bytes:
                yield archive()
                held, size = [], 0
    if held:
        yield archive()


def gzipped(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES, **columns: str) -> None:
    """Writes three records for each capture: request, response (or revisit) and metadata."""
    c = captures(pages, **columns)
    n, crlf = F.lit("\r\n"), "\r\n"
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    host, rest = F.regexp_extract("url", r"^[^:/]+://([^/?#\s]*)", 1), F.regexp_extract(uri, r"^[^:/]+://[^/?#]*([^#]*)", 1)

    def record(kind: str | F.Column, own: F.Column, block: F.Column, *headers: F.Column) -> F.Column:
        head = F.concat(F.lit(f"WARC/1.1{crlf}WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind, n, F.lit("WARC-Record-ID: "), own, n, F.lit(f"WARC-Date: {date}{crlf}WARC-Target-URI: "), uri, n)
        return F.concat(head, *headers, F.lit("Content-Length: "), F.octet_length(block).cast("string"), n, n, block)

    other = lambda mark: F.concat(F.lit("<urn:uuid:"), F.lit(mark), F.substring("capture", 11, 36))
    to = F.concat(F.lit("WARC-Concurrent-To: "), F.col("capture"), n)
    again = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "), F.col("payload_bytes").cast("string"), n, n)
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest"), n, F.lit(f"Content-Type: application/http;msgtype=response{crlf}"))
    refers = F.when(again, F.concat(F.lit("WARC-Refers-To: "), F.col("refers_to"), n, F.lit(f"WARC-Profile: {PROFILE}{crlf}"))).otherwise(F.lit(""))
    page = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), n)
    records = F.array(
        record("request", F.concat(other("req-"), F.lit(">")), F.concat(F.lit("GET "), F.when(rest == "", F.lit("/")).otherwise(rest), F.lit(f" HTTP/1.1{crlf}Host: "), host, n, n), to, F.lit(f"Content-Type: application/http;msgtype=request{crlf}")),
        record(F.when(again, F.lit("revisit")).otherwise(F.lit("response")), F.col("capture"), F.concat(http, F.when(again, F.lit("")).otherwise(F.col("payload"))), digest, refers),
        record("metadata", F.concat(other("meta-"), F.lit(">")), page, to, F.lit(f"Content-Type: application/warc-fields{crlf}")),
    )
    archives = c.select(F.explode(records).alias("record")).mapInArrow(lambda batches: members(batches, archive_bytes), "value binary")
    archives.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def walk(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers by lower-case name, block) of each record, of an archive with or without compression."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\x1f\x8b":
            unpacker, parts, to = zlib.decompressobj(31), [], at
            while not unpacker.eof:
                if to >= len(data):
                    raise ValueError(f"cut gzip member at byte {at}")
                parts.append(unpacker.decompress(data[to : to + WINDOW]))
                to += WINDOW
            raw, start = b"".join(parts), 0
            size = min(to, len(data)) - at - len(unpacker.unused_data)
        else:
            raw, start, size = data, at, 0
        if start < len(raw):
            end = raw.index(b"\r\n\r\n", start)
            first, *lines = raw[start:end].decode("utf-8", "replace").split("\r\n")
            if not first.startswith("WARC/"):
                raise ValueError(f"no WARC record at byte {at}")
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            n = int(headers["content-length"])
            yield at, headers, raw[end + 4 : end + 4 + n]
            size = size or end + 4 + n + 4 - at
        at += size


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row for each record of the archives in a folder; digest and size of a response are taken from its payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [x.split()[0] for x in RECORD.split(", ")]
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_py()
                rows: list[tuple] = []
                held = 0
                for at, h, block in walk(data):
                    kind, page, n, digest, payload = h["warc-type"], None, None, None, None
                    if kind in ("response", "revisit"):
                        body = bytes(block).partition(b"\r\n\r\n")[2]
                        digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
                        if kind == "response":
                            n, digest = len(body), hashlib.sha1(body).hexdigest()
                            payload = body.decode() if with_payload else None
                    elif kind == "metadata":
                        value = bytes(block).decode().partition("page-id:")[2].partition("\r\n")[0].strip()
                        page = int(value) if value else None
                    rows.append((file, at, kind, h["warc-record-id"], h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), page, n, digest, payload))
                    held += len(block)
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RECORD)


def assemble(records: DataFrame, kept: Kept) -> DataFrame:
    """One nested row per capture: request, response and metadata, brought together by WARC-Concurrent-To; a revisit's size is that of the response it refers to.

    The captures are written once: archives are parsed once, and revisits look their response up in the written table."""
    kind = lambda *names: F.col("type").isin(*names)
    whole = records.groupBy(F.when(kind("response", "revisit"), F.col("record_id")).otherwise(F.col("concurrent_to")).alias("capture")).agg(
        F.max(F.when(kind("response", "revisit"), F.struct("record_id", "type", "target_uri", "payload", "payload_bytes", "payload_digest", "refers_to", "file", "at"))).alias("response"),
        F.min(F.when(kind("request"), F.struct("record_id", "target_uri"))).alias("request"),
        F.min(F.when(kind("metadata"), F.struct("record_id", "page_id"))).alias("metadata"),
    )
    whole = kept.keep(whole.where("response IS NOT NULL").drop("capture"), "captures")
    first = whole.where("response.type = 'response'").select(F.col("response.record_id").alias("of"), F.col("metadata.page_id").alias("of_page"), F.col("response.payload_bytes").alias("of_bytes"))
    again = whole.where("response.type = 'revisit'").withColumn("of", F.col("response.refers_to"))
    # only responses that some revisit names meet the revisits
    again = again.join(first.join(again.select("of").distinct(), "of", "left_semi"), "of", "left").drop("of")
    none = whole.where("response.type != 'revisit'").withColumns({"of_page": F.lit(None).cast("long"), "of_bytes": F.lit(None).cast("long")})
    of = lambda *names: [F.col(f"response.{x}").alias(x) for x in names]
    return none.unionByName(again).select(
        F.col("metadata.page_id").alias("page_id"),
        F.struct(*of("record_id", "type", "target_uri", "payload"), F.coalesce("response.payload_bytes", "of_bytes").alias("payload_bytes"), *of("payload_digest"), F.col("of_page").alias("refers_to"), *of("file", "at")).alias("response"),
        "request",
        F.struct("metadata.record_id").alias("metadata"),
    )


def round_trip(spark: SparkSession, pages: DataFrame, with_payload: bool = False) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back as captures."""
    kept = Kept(spark)
    path = f"{kept.at}/warc"
    write(pages, path)
    return assemble(read(spark, path, with_payload), kept)
