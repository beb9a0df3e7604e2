"""WARC archives: written through Spark's text sink, so that any file system will do, and read back as captures.

Each page becomes a request, a response or revisit, and a metadata record, tied by WARC-Concurrent-To. A record ends with two line
ends, and those are the sink's line separator, so the files are plain WARC/1.1 whatever the payloads hold.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, stored

EOL = "\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Bytes that a file should have.
FILE = 32 << 20


def base32_sha1(data: Column) -> Column:
    """The SHA-1 of a string or binary column in upper-case base32: five hex digits are four letters."""
    digest = F.sha1(data)
    letters = []
    for g in range(8):
        n = F.conv(F.substring(digest, 5 * g + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(ALPHABET), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _urn(row: Column, kind: str) -> Column:
    h = F.md5(F.concat(row.cast("string"), F.lit(":" + kind)).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(kind: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record without its closing line ends. Headers whose value is null are left out."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind)]
    lines += [F.concat(F.lit(k + ": "), v) for k, v in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(EOL, *lines), F.lit(2 * EOL), block)


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write the rows of pages (page_id, url, html) to WARC files under path, the payload html in UTF-8 (null: empty).

    Of pages with equal payloads of min_bytes at least, the one with the smallest page_id (a null one last; of equal ones the first
    read) is written as response, the others as revisits of it without payload; smaller payloads are all responses. A null url has
    no target, a null page_id no such field. Other columns are not read. pages must give the same rows in the same order each time
    it is read, as files do.
    """
    d = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace("url", r"[\r\n]+", "").alias("url"), F.coalesce("html", F.lit("")).alias("html"), F.monotonically_increasing_id().alias("row"))
    d = d.withColumn("digest", base32_sha1(F.col("html"))).withColumn("bytes", F.octet_length("html"))
    first = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    same = d.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.count("*").alias("c"), F.min(first).alias("first"))
    same = stored(same.where("c > 1").select("digest", F.col("first.row").alias("first")), "payloads")
    size = d.agg(F.count("*"), F.sum("bytes")).first()
    d = d.join(same, "digest", "left").withColumn("again", F.coalesce(F.col("first") != F.col("row"), F.lit(False)) & (F.col("bytes") >= min_bytes))
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url"))]
    me = _urn(F.col("row"), "capture")
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("bytes").cast("string"), F.lit(2 * EOL))
    request = _record(
        F.lit("request"),
        [("WARC-Record-ID", _urn(F.col("row"), "request")), *common, ("WARC-Concurrent-To", me), ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(f" HTTP/1.1{2 * EOL}")),
    )
    capture = _record(
        F.when(F.col("again"), "revisit").otherwise("response"),
        [
            ("WARC-Record-ID", me),
            *common,
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
            ("WARC-Profile", F.when(F.col("again"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ("WARC-Refers-To", F.when(F.col("again"), _urn(F.col("first"), "capture"))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.when(F.col("again"), head).otherwise(F.concat(head, "html")),
    )
    meta = _record(
        F.lit("metadata"),
        [("WARC-Record-ID", _urn(F.col("row"), "metadata")), *common, ("WARC-Concurrent-To", me), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("fetched-by: kinship"), F.coalesce(F.concat(F.lit(f"{EOL}page-id: "), F.col("page_id").cast("string")), F.lit("")), F.lit(EOL)),
    )
    each = max(1, FILE // (1500 + (size[1] or 0) // max(1, size[0])))
    d.select(F.explode(F.array(request, capture, meta)).alias("value")).write.option("lineSep", 2 * EOL).option("maxRecordsPerFile", 3 * each).text(path)


class BadWarc(ValueError):
    """Bytes that are no WARC record."""


def records_of(data: bytes) -> Iterator[tuple[str, dict[str, str], memoryview]]:
    """(type, headers by lower-case name, block) of each record of a file."""
    view, at = memoryview(data), 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/1.", at):
            raise BadWarc(f"no record at byte {at}")
        lines = data[at:end].decode().split(EOL)[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        at = end + 4
        size = int(headers["content-length"])
        if data[at + size : at + size + 4] != b"\r\n\r\n":
            raise BadWarc(f"the record before byte {at + size} doesn't end there")
        yield headers.get("warc-type", ""), headers, view[at : at + size]
        at += size + 4


RECORD = "record_id string, record_type string, target_uri string, date string, concurrent_to string, refers_to string, payload_digest string, payload_bytes long, fields map<string,string>"


def _parsed(with_payload: bool):
    schema = pa.schema([(x, pa.string()) for x in ("record_id", "record_type", "target_uri", "date", "concurrent_to", "refers_to", "payload_digest")] + [("payload_bytes", pa.int64()), ("fields", pa.map_(pa.string(), pa.string()))] + [("payload", pa.binary())] * with_payload)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                rows, held = [], 0
                for kind, h, block in records_of(data.as_py()):
                    payload, fields = None, {}
                    if kind == "response":
                        raw = block.tobytes()
                        payload = raw[raw.index(b"\r\n\r\n") + 4 :]
                    elif kind == "metadata":
                        fields = dict(x.split(": ", 1) for x in block.tobytes().decode().split(EOL) if ": " in x)
                    digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    if payload is not None:
                        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if digest not in (None, found):
                            raise BadWarc(f"the payload of {h.get('warc-record-id')} doesn't have its digest")
                        digest = found
                        held += with_payload * len(payload)
                    rows.append((h.get("warc-record-id"), kind, h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), digest, None if payload is None else len(payload), list(fields.items()), payload)[: len(schema)])
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def read_records(spark, path: str, payload: bool = True) -> DataFrame:
    """The records of the WARC files under path, one row each; payloads only if asked for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_parsed(payload), RECORD + ", payload binary" * payload)


def captures(records: DataFrame) -> DataFrame:
    """One nested row a capture: (record_id, capture, request, metadata), structs of the records' columns. A request or metadata
    record belongs to the response or revisit that it is concurrent to; null where there is none. Should a capture have several of
    a kind, the one with the least record_id is taken."""
    own = [c for c in records.columns if c != "payload"]

    def of(kind: str) -> DataFrame:
        rows = records.where(F.col("record_type") == kind).where("concurrent_to is not null")
        return rows.groupBy(F.col("concurrent_to").alias("record_id")).agg(F.min_by(F.struct(*own), "record_id").alias(kind))

    main = records.where(F.col("record_type").isin("response", "revisit")).select("record_id", F.struct(*records.columns).alias("capture"))
    return main.join(of("request"), "record_id", "left").join(of("metadata"), "record_id", "left")


def page_digests(spark, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each capture in the files; a revisit's payload is that
    of the response that it refers to."""
    c = captures(stored(read_records(spark, path, payload=False), "records"))
    page = F.col("metadata.fields")["page-id"].cast("long")
    c = stored(c.select("record_id", page.alias("page_id"), "capture.record_type", "capture.payload_bytes", "capture.payload_digest", F.col("capture.refers_to").alias("to")), "captures")
    first = c.where("record_type = 'response'").select(F.col("record_id").alias("to"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("first_bytes"))
    first = first.join(c.select("to").distinct(), "to", "left_semi")
    # Responses refer to none: they don't meet in a join by null.
    out = c.where("to is not null").join(first, "to", "left").unionByName(c.where("to is null").withColumns({"refers_to": F.lit(None).cast("long"), "first_bytes": F.lit(None).cast("long")}))
    return out.select("page_id", F.coalesce("payload_bytes", "first_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
