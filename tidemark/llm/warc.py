"""Web captures as WARC transactions: written as archives, read back and joined to one nested row per capture.

Every capture is three records: request, response (or revisit of an earlier
response with the same payload) and metadata. Request and metadata name the
response in WARC-Concurrent-To.
"""

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

END = "\r\n"
GAP = b"\r\n\r\n"
# Format version, profile of revisits, alphabet of base32, kinds of records that are captures.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CAPTURES = ("response", "revisit")

RECORD = (
    "record_type string, record_id string, concurrent_to string, refers_to string, target_uri string, date string, "
    "payload_digest string, payload_bytes long, page_id long, payload binary"
)


def payload_digest(payload: Column) -> Column:
    """Bare base32 of SHA-1: five hex digits are four letters."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _record_id(capture: Column, copy: Column, kind: str) -> Column:
    h = F.md5(F.concat_ws("/", capture, copy, F.lit(kind)))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record without the two line ends behind it; a header whose value is null is left out."""
    lines = [F.concat(F.lit(f"{END}{name}: "), F.regexp_replace(value, "[\r\n]", " ")) for name, value in headers]
    length = F.concat(F.lit(f"{END}Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.lit(VERSION), *[F.coalesce(x, F.lit("")) for x in lines], length, F.lit(END + END), block)


def write_archives(
    pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, date: str = "2026-01-01T00:00:00Z"
) -> None:
    """Writes the captures of ``pages`` as gzip WARC files into ``folder``, through Spark's own writer.

    Of rows with equal payloads (UTF-8 of ``html``) of at least ``min_bytes``,
    that with the largest id is the response, and the others revisit it; of
    rows that tie, the one with the largest address. Rows that repeat a whole
    row revisit the first copy. A null payload is empty, a null id is smaller
    than others and a null address is left out of the records. Other columns
    are not read.
    """
    rows = pages.select(F.col(id).cast("long").alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", payload_digest(F.col("html"))).withColumn("size", F.octet_length("html"))
    rows = rows.withColumn("capture", F.md5(F.to_json(F.struct("id", "url", "digest"))))
    # whom a capture revisits, from the small columns alone
    named = rows.filter(F.col("size") >= min_bytes).select("capture", "digest", "id", "url")
    named = named.groupBy("capture").agg(*[F.first(c).alias(c) for c in ("digest", "id", "url")])
    target = named.groupBy("digest").agg(F.max(F.struct("id", "url", "capture")).alias("target"))
    revisits = named.join(target, "digest").filter("capture <> target.capture").select("capture", "target")
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("capture").orderBy("capture")))
    rows = rows.join(revisits, "capture", "left")
    again = (F.col("copy") > 1) & (F.col("size") >= min_bytes)
    rows = rows.withColumn("target", F.when(F.col("target").isNull() & again, F.struct("id", "url", "capture")).otherwise(F.col("target")))

    own = _record_id(F.col("capture"), F.col("copy"), "response")
    old = F.col("target").isNotNull()
    line = lambda text: F.lit(text + END)
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"^\w+://([^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\w+://[^/?#]*([^#]*)", 1), "[\r\n]", " ")
    asked = F.concat(F.lit("GET "), F.when(path == "", "/").otherwise(path), line(" HTTP/1.1"), F.lit("Host: "), host, line(""), line(""))
    head = F.concat(line("HTTP/1.1 200 OK"), line("Content-Type: text/html; charset=utf-8"), F.lit("Content-Length: "), F.col("size"), line(""), line(""))
    about = F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("id"), line("")), F.lit("")), F.lit("copy: "), F.col("copy"), line(""))
    common = [("WARC-Target-URI", F.col("url")), ("WARC-Date", F.lit(date))]
    http = ("Content-Type", F.lit("application/http"))
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", _record_id(F.col("capture"), F.col("copy"), "request")), ("WARC-Concurrent-To", own), *common, http],
        asked,
    )
    response = _record(
        [
            ("WARC-Type", F.when(old, "revisit").otherwise("response")),
            ("WARC-Record-ID", own),
            ("WARC-Refers-To", F.when(old, _record_id(F.col("target.capture"), F.lit(1), "response"))),
            ("WARC-Refers-To-Target-URI", F.when(old, F.col("target.url"))),
            ("WARC-Profile", F.when(old, REVISIT_PROFILE)),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            *common,
            http,
        ],
        F.when(old, head).otherwise(F.concat(head, F.col("html"))),
    )
    metadata = _record(
        [
            ("WARC-Type", F.lit("metadata")),
            ("WARC-Record-ID", _record_id(F.col("capture"), F.col("copy"), "metadata")),
            ("WARC-Concurrent-To", own),
            *common,
            ("Content-Type", F.lit("application/warc-fields")),
        ],
        about,
    )
    records = rows.select(F.explode(F.array(request, response, metadata)).alias("value"))
    # what the writer puts behind each row is what ends a record
    records.write.option("lineSep", GAP.decode()).option("compression", "gzip").text(folder)


def _headers(head: bytes) -> dict[bytes, bytes]:
    pairs = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


class _Reader:
    """Puts records together again from the stretches between blank lines of one file."""

    def __init__(self):
        self.head, self.length, self.block = None, 0, []
        self.held = 0

    def take(self, stretch: bytes):
        """The records that end with this stretch: (headers, block)."""
        while True:
            if self.head is None:
                stretch = stretch.lstrip(b"\r\n")
                if not stretch.startswith(b"WARC/"):
                    return  # no record begins here
                self.head = _headers(stretch)
                self.length = int(self.head.get(b"content-length", b"0"))
                self.block, self.held = [], -len(GAP)
                return
            self.block.append(stretch)
            self.held += len(GAP) + len(stretch)
            if self.held < self.length:
                return
            whole = GAP.join(self.block)
            yield self.head, whole[: self.length]
            self.head, stretch = None, whole[self.length :]
            if not stretch:
                return


def _told(head: dict[bytes, bytes], block: bytes, payloads: bool) -> tuple:
    text = lambda name: head[name].decode("utf-8", "replace") if name in head else None
    kind, digest, size, payload, page = text(b"warc-type"), text(b"warc-payload-digest"), None, None, None
    digest = digest.removeprefix("sha1:") if digest else None
    if head.get(b"content-type", b"").startswith(b"application/http"):
        top, _, payload = block.partition(GAP)
        size = len(payload)
        if kind == "response":
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        elif kind == "revisit":
            length = _headers(top).get(b"content-length", b"")
            size, payload = int(length) if length.isdigit() else None, None
    elif kind == "metadata":
        fields = _headers(b"\r\n" + block)
        page = int(fields[b"page-id"]) if b"page-id" in fields else None
    return (
        kind, text(b"warc-record-id"), text(b"warc-concurrent-to"), text(b"warc-refers-to"), text(b"warc-target-uri"),
        text(b"warc-date"), digest, size, page, payload if payloads else None,
    )


def read_records(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of all gzip WARC files in ``folder`` (one member or one for each record).

    A file is read as a stream by one task, which holds one record at a time;
    Content-Length says where a record ends, whatever its block has in it.
    ``payloads=False`` leaves the payload column null. What no record begins
    with is passed over; a record that its file cuts off is not told.
    """
    names = [f.split()[0] for f in RECORD.split(", ")]
    kinds = [pa.string()] * 7 + [pa.int64()] * 2 + [pa.binary()]

    def run(batches):
        reader, file = None, None
        for batch in batches:
            done = []
            for path, stretch in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist()):
                if path != file:
                    reader, file = _Reader(), path
                done += [_told(*r, payloads) for r in reader.take(stretch)]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)

    lines = spark.read.option("lineSep", GAP.decode()).text(folder)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    return lines.mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: (capture_id, response, request, metadata).

    Requests and metadata join the response or revisit that they name as
    concurrent; where there is none, the row has a null response. Records
    without an id, and requests and metadata without a concurrent record, are
    left out. Of records that repeat an id, and of several requests or metadata
    records of one capture, the smallest stays.
    """
    columns = [c for c in records.columns if c != "record_type"]

    def of(kinds, key, name):
        rows = records.filter(F.col("record_type").isin(*kinds) & F.col(key).isNotNull())
        first = ["record_id", "record_type", *[c for c in columns if c != "record_id"]]
        return rows.groupBy(F.col(key).alias("capture_id")).agg(F.min(F.struct(*first)).alias(name))

    rows = of(CAPTURES, "record_id", "response")
    rows = rows.join(of(("request",), "concurrent_to", "request"), "capture_id", "full")
    return rows.join(of(("metadata",), "concurrent_to", "metadata"), "capture_id", "full")


def with_referred(captures: DataFrame) -> DataFrame:
    """Adds ``refers_to_page``: the page of the response that a revisit names."""
    pages = captures.filter("response.record_type = 'response'")
    pages = pages.select(F.col("capture_id").alias("_to"), F.col("metadata.page_id").alias("refers_to_page"))
    return captures.withColumn("_to", F.col("response.refers_to")).join(pages, "_to", "left").drop("_to")
