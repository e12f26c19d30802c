"""WARC archives: writing, reading back, and transaction assembly (operator 6).

Writing: each page is one capture of three records - request, response (or
revisit) and metadata - where request and metadata name the response by
WARC-Concurrent-To. Of captures with equal payloads of at least ``least``
bytes, the one with the smallest page_id (then url) is the response, the
others are revisits that refer to it. Equal rows are captures of their own,
told apart by a copy number in their record ids. Spark's text writer puts the records
into gzip files; the blank lines that end a record are its line separator.

Reading: a streaming parser walks the lines of each file and takes as many
bytes as Content-Length says, so payloads may hold anything, and no file is
held whole. Digests are computed anew from the payloads read.

Assembly: responses are joined with their request and metadata records by
the concurrent-to identifiers; one nested row per capture comes out.

Null html is an empty payload; a null url leaves the target out; a null
page_id sorts last. Record ids follow from (page_id, url, payload digest, copy),
so every row gives one row back. An empty table gives no captures. A record whose length and separator disagree is an error.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metrolens.llm.common import stored
from metrolens.session import scratch_path

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(hexed: str) -> Column:
    """Base32 of a hexadecimal SHA-1 column: 5 hex digits are 4 base32 digits."""
    digits = [f"substr('{BASE32}', ((conv(substr({hexed}, {g * 5 + 1}, 5), 16, 10) >> {s}) & 31) + 1, 1)"
              .replace("conv(", "cast(conv(").replace(", 16, 10)", ", 16, 10) as int)")
              for g in range(8) for s in (15, 10, 5, 0)]
    return F.expr("concat(" + ", ".join(digits) + ")")


def record_id(kind: str, page_id: str, url: str, digest: str, copy: Column) -> Column:
    key = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(F.col(page_id).cast("string"), F.lit("-")), F.col(digest),
                            copy.cast("string"), F.coalesce(F.col(url), F.lit("-"))).cast("binary"))
    parts = [F.substring(key, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _lines(*parts) -> Column:
    """Header lines; a null line is left out."""
    cols = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.concat(*[F.coalesce(F.concat(c, F.lit(CRLF)), F.lit("")) for c in cols], F.lit(CRLF))


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value.cast("string"))


def _record(kind: Column, rid: Column, content_type: str, block: Column, date: str, *more: Column) -> Column:
    return F.concat(_lines("WARC/1.1", _field("WARC-Type", kind), _field("WARC-Record-ID", rid),
                           f"WARC-Date: {date}", *more, f"Content-Type: {content_type}",
                           _field("Content-Length", F.octet_length(block))), block)


def captures(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages with payload, digest, and for revisits the page they refer to.
    The table of first pages is written before the join, so that the rows of a
    payload which very many pages share are split among tasks."""
    p = pages.select("page_id", F.regexp_replace("url", "[\\r\\n]", "").alias("url"),
                     F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("key", F.struct("sha", "page_id", "url"))
    counted = p.groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    order = F.struct(F.col("key.page_id").isNull().alias("unnamed"), F.col("key.page_id").alias("page_id"), F.col("key.url").alias("url"))
    firsts = stored(spark, counted.groupBy("key.sha").agg(F.min(order).alias("f")).select(
        F.col("sha").alias("first_sha"), F.col("f.page_id").alias("first_page"), F.col("f.url").alias("first_url")),
        "first-pages")
    # equal rows are brought together by partial sums and numbered; all others pass by
    repeats = stored(spark, counted.where("copies > 1"), "repeated-pages")
    equal = p.join(repeats, "key").groupBy("key").agg(F.first("html").alias("html"), F.max("copies").alias("copies"))
    copies = equal.select("key.page_id", "key.url", "html", "key.sha", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    rows = p.join(repeats, "key", "left_anti").select("page_id", "url", "html", "sha", F.lit(1).cast("long").alias("copy")).unionByName(copies)
    own = F.col("page_id").eqNullSafe(F.col("first_page")) & F.col("url").eqNullSafe(F.col("first_url")) & (F.col("copy") == 1)
    return (rows.join(firsts, F.col("sha") == F.col("first_sha"))
            .withColumn("revisit", (F.octet_length("html") >= least) & ~own))


def write_archives(spark: SparkSession, pages: DataFrame, path: str, least: int = 0,
                   date: str = "2024-01-01T00:00:00Z") -> None:
    c = captures(spark, pages, least)
    main = record_id("response", "page_id", "url", "sha", F.col("copy"))
    target = _field("WARC-Target-URI", F.col("url"))
    concurrent = _field("WARC-Concurrent-To", main)
    length = F.octet_length("html")
    http = _lines("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", _field("Content-Length", length))
    asked = _lines(F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(" HTTP/1.1")), "Accept: text/html")
    about = _lines(_field("page-id", F.col("page_id")), _field("payload-length", length))
    revisit = lambda name, value: F.when(F.col("revisit"), _field(name, value))
    records = [
        _record(F.lit("request"), record_id("request", "page_id", "url", "sha", F.col("copy")),
                "application/http; msgtype=request", asked, date, target, concurrent),
        _record(F.when(F.col("revisit"), "revisit").otherwise("response"), main,
                "application/http; msgtype=response",
                F.concat(http, F.when(F.col("revisit"), "").otherwise(F.col("html"))), date, target,
                F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_of_hex("sha")),
                revisit("WARC-Profile", F.lit(PROFILE)),
                revisit("WARC-Refers-To", record_id("response", "first_page", "first_url", "sha", F.lit(1)))),
        _record(F.lit("metadata"), record_id("metadata", "page_id", "url", "sha", F.col("copy")),
                "application/warc-fields", about, date, target, concurrent),
    ]
    end = CRLF + CRLF
    c.select(F.concat_ws(end, *records).alias("value")).write.option("lineSep", end) \
        .option("compression", "gzip").text(path)


RECORD = ("kind string, record_id string, concurrent_to string, refers_to string, target_uri string, date string, "
          "payload_digest string, payload_length long, payload binary, fields map<string,string>")


def parse_record(head: list[bytes], block: bytes, payload: bool) -> dict:
    fields = {}
    for line in head[1:]:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    kind = fields.get("warc-type")
    out = {"kind": kind, "record_id": fields.get("warc-record-id"), "concurrent_to": fields.get("warc-concurrent-to"),
           "refers_to": fields.get("warc-refers-to"), "target_uri": fields.get("warc-target-uri"),
           "date": fields.get("warc-date"), "payload_digest": None, "payload_length": None, "payload": None, "fields": None}
    if kind == "response":
        body = block.partition(b"\r\n\r\n")[2]
        out["payload_digest"] = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out["payload_length"] = len(body)
        out["payload"] = body if payload else None
    elif kind == "revisit":
        out["payload_digest"] = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    elif kind == "metadata":
        pairs = (line.partition(": ") for line in block.decode("utf-8", "replace").split("\r\n") if line)
        out["fields"] = [(k, v) for k, _, v in pairs]
    return out


def records_of(lines, payload: bool):
    """Records of the lines (file, bytes) of whole files, one after another."""
    file, head, parts, need = None, [], [], 0

    def complete():
        if file is not None and (parts or need or head):
            raise ValueError(f"{file} ends inside a record")

    for name, line in lines:
        if name != file:
            complete()
            file, head, parts, need = name, [], [], 0
        if need:
            parts.append(line)
            need -= len(line) + 1
            if need < 0:
                raise ValueError(f"{file}: a record's length does not end at its separator")
            if need == 0:
                yield parse_record(head, b"\n".join(parts)[:-3], payload)
                head, parts = [], []
        elif line != b"\r":
            if not head and not line.startswith(b"WARC/"):
                raise ValueError(f"{file}: a record does not start with its version")
            head.append(line.rstrip(b"\r"))
        elif head:
            length = next((x for x in head if x.lower().startswith(b"content-length:")), None)
            if length is None:
                raise ValueError(f"{file}: a record has no length")
            need = int(length.partition(b":")[2]) + 4        # the block and two line ends
    complete()


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of all archives below ``path``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    schema = to_arrow_schema(StructType.fromDDL(RECORD))

    def run(batches):
        lines = ((f, v) for b in batches for f, v in zip(b.column("file").to_pylist(), b.column("value").to_pylist()))
        rows, size = [], 0
        for record in records_of(lines, payload):
            rows.append(record)
            size += len(record["payload"] or b"") + 500
            if size > 4_000_000:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value")) \
        .mapInArrow(run, RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: the response or revisit with the request
    and metadata records that are concurrent to it. Repeated record ids count
    once."""
    main = records.where("kind IN ('response', 'revisit')").dropDuplicates(["record_id"])
    request = records.where("kind = 'request'").dropDuplicates(["concurrent_to"])
    meta = records.where("kind = 'metadata'").dropDuplicates(["concurrent_to"])
    nested = lambda df, name, cols: df.select(
        F.col("concurrent_to" if name != "response" else "record_id").alias("capture"), F.struct(*cols).alias(name))
    return (nested(main, "response", ["record_id", "kind", "target_uri", "date", "payload_digest", "payload_length",
                                      "refers_to", "payload"])
            .join(nested(request, "request", ["record_id", "target_uri", "date"]), "capture", "left")
            .join(nested(meta, "metadata", ["record_id", "fields"]), "capture", "left"))


def with_origins(captures: DataFrame, column: Column) -> DataFrame:
    """Captures with ``origin``: ``column`` of the response that a revisit's
    WARC-Refers-To names, null for others and where that response is missing."""
    rows = captures.withColumn("_refers", F.col("response.refers_to"))
    named = captures.where("response.kind = 'response'").select(F.col("response.record_id").alias("_refers"), column.alias("origin"))
    revisits = rows.where("_refers IS NOT NULL").join(named, "_refers", "left")
    others = rows.where("_refers IS NULL").withColumn("origin", F.lit(None).cast(named.schema["origin"].dataType))
    return revisits.select(*others.columns).unionByName(others).drop("_refers")


def round_trip(spark: SparkSession, pages: DataFrame, least: int = 0, payload: bool = True) -> DataFrame:
    """Write the archives below the shared checkpoint folder, read them back."""
    path = scratch_path(spark, "warc")
    write_archives(spark, pages, path, least)
    return transactions(stored(spark, read_archives(spark, path, payload), "warc-records"))
