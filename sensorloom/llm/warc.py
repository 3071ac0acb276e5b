"""WARC archives: write captures as linked records, read archives, and put a capture together again.

Writing: each capture becomes a request, a response (or revisit) and a metadata record; request and metadata
name the response in WARC-Concurrent-To. Each record is a gzip member of its own. Spark's text writer
puts the bytes into files of any store Spark can write to; between captures it needs a separator, which is
an empty gzip member and unpacks to nothing. A file holds one task's captures; a lost task is written anew as a whole.

Reading: files come as binary rows, and records are cut by their Content-Length, so payloads may contain anything. A
file has to fit into a cell (2 GB); the writer's files have the size of a shuffle partition.

Assembly: the principal record (response, revisit or resource) is the capture. Requests and metadata join it
through concurrent-to identifiers in either direction, directly or through one other record of the
capture. One nested row per capture results. Where a capture has several requests or metadata records, the one with the smallest
id stands in the row and the number is given; ``unattached`` lists records without any capture.

A revisit has no payload. It is resolved through its payload digest: the response that holds the payload.

Defined results: a null payload is empty; a null address is left out and read back as null, control
characters and spaces in it are percent-encoded; a null id is read back as null, and such a row is a response; repeated rows are
captures of their own with ids of their own, and all copies of the chosen row are responses; an empty
table gives an archive without records and no captures; other columns are not written.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST_REVISIT = 1000  # bytes; smaller payloads are stored each time
PRINCIPAL = ("response", "revisit", "resource")
STEP = 1 << 13  # bytes fed to the unpacker at a time
DATE = "2024-01-01T00:00:00Z"
EMPTY_MEMBER = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 3, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
RECORD = "record_id string, type string, concurrent_to array<string>, target_uri string, declared_digest string, fields string, payload binary, payload_bytes long, payload_sha1 string"


# --- Writing -----------------------------------------------------------------------------------


def record(kind: str, record_id: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", DATE), *headers, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines if v is not None).encode() + b"\r\n" + block + b"\r\n\r\n"


def capture_records(new_id, page: str | None, url: str | None, html: bytes, digest: str, revisit: bool) -> Iterator[bytes]:
    import re
    from urllib.parse import urlsplit

    shown = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    try:
        parts = urlsplit(shown or "")
        asked = f"GET {parts.path or '/'}{'?' + parts.query if parts.query else ''} HTTP/1.1\r\nHost: {parts.netloc}\r\n\r\n"
    except ValueError:
        asked = "GET / HTTP/1.1\r\n\r\n"
    main, uri = new_id(), ("WARC-Target-URI", shown)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    yield record("request", new_id(), [uri, ("WARC-Concurrent-To", main), ("Content-Type", "application/http; msgtype=request")], asked.encode())
    yield record("revisit" if revisit else "response", main, [
        uri, ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
    ], head if revisit else head + html)
    yield record("metadata", new_id(), [uri, ("WARC-Concurrent-To", main), ("Content-Type", "application/warc-fields")], b"" if page is None else f"page-id: {page}\r\n".encode())


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST_REVISIT) -> None:
    """Write an archive. Of captures with equal payloads of at least ``least`` bytes, the one with the largest key keeps the payload."""
    raw = F.coalesce(F.encode(F.col(payload), "UTF-8"), F.lit(b""))
    own = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), raw.alias("payload")).withColumn("digest", F.sha1("payload"))
    # Only digests that several captures share take part; they shrink to one row per task before the shuffle.
    shared = own.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("key").alias("kept"), F.count("*").alias("n")).where("n > 1").select("digest", "kept")
    told = own.join(shared, "digest", "left").select(F.col("key").cast("string").alias("key"), "url", "payload", "digest", F.coalesce(F.col("key") < F.col("kept"), F.lit(False)).alias("revisit"))
    run = uuid.uuid4()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        from pyspark import TaskContext

        count = 0
        task = TaskContext.get().partitionId()

        def new_id() -> str:
            nonlocal count
            count += 1
            return f"<urn:uuid:{uuid.uuid5(run, f'{task}-{count}')}>"

        def member(data: bytes) -> bytes:
            press = zlib.compressobj(5, zlib.DEFLATED, 31)
            return press.compress(data) + press.flush()

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = batch.slice(start, 256).to_pylist()
                out = [b"".join(map(member, capture_records(new_id, r["key"], r["url"], r["payload"], r["digest"], r["revisit"]))) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    files = told.mapInArrow(make, "value binary").select(F.col("value").cast("string"))
    files.write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


# --- Reading -----------------------------------------------------------------------------------


def unpacked(data: bytes) -> Iterator[bytes]:
    """The content of a file in pieces: of each gzip member, or of a file that isn't packed as it is."""
    import zlib

    view, at = memoryview(data), 0
    while at < len(view):
        if bytes(view[at : at + 2]) != b"\x1f\x8b":
            yield bytes(view[at:])
            return
        opened, parts = zlib.decompressobj(31), []
        while not opened.eof and at < len(view):  # small steps: what follows the member is copied
            step = view[at : at + STEP]
            parts.append(opened.decompress(step))
            at += len(step) - len(opened.unused_data)
        yield b"".join(parts)


def records_in(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(headers, block) of each record, cut by Content-Length. A record cut off at the end is an error."""
    buffer, at = b"", 0
    for piece in unpacked(data):
        buffer, at = (buffer[at:] + piece if at < len(buffer) else piece), 0
        while at < len(buffer):
            if buffer.startswith(b"\r\n", at):
                at += 2
                continue
            end = buffer.find(b"\r\n\r\n", at)
            if end < 0:
                break
            lines = buffer[at:end].decode("utf-8", "replace").split("\r\n")
            headers = [(k.strip().lower(), v.strip()) for k, _, v in (line.partition(":") for line in lines[1:])]
            stop = end + 4 + int(dict(headers).get("content-length", 0))
            if len(buffer) < stop:
                break
            yield headers, buffer[end + 4 : stop]
            at = stop
    if buffer[at:].strip(b"\r\n"):
        raise ValueError("the archive ends inside a record")


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record. ``payload`` is the body of an HTTP response or the block of a resource; its length and SHA-1 are computed from it."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        def row(headers: list[tuple[str, str]], block: bytes) -> dict:
            one = dict(headers)
            kind = one.get("warc-type")
            body = None
            if kind == "resource":
                body = block
            elif kind == "response":
                body = block.partition(b"\r\n\r\n")[2] if "application/http" in one.get("content-type", "") else block
            return {
                "record_id": one.get("warc-record-id"), "type": kind, "concurrent_to": [v for k, v in headers if k == "warc-concurrent-to"],
                "target_uri": one.get("warc-target-uri"), "declared_digest": one.get("warc-payload-digest"),
                "fields": block.decode("utf-8", "replace") if kind in ("request", "metadata", "revisit") else None,
                "payload": body, "payload_bytes": None if body is None else len(body), "payload_sha1": None if body is None else hashlib.sha1(body).hexdigest(),
            }

        kinds = {"concurrent_to": pa.list_(pa.string()), "payload": pa.binary(), "payload_bytes": pa.int64()}
        names = [c.split()[0] for c in RECORD.split(", ")]
        schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for headers, block in records_in(content.as_py()):
                    rows.append(row(headers, block))
                    held += len(block)
                    if held > 4 << 20 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, RECORD)


# --- Assembly ----------------------------------------------------------------------------------


def _captures_of(records: DataFrame) -> DataFrame:
    """(``record_id``, ``capture``) for every record that isn't principal and belongs to one."""
    main = records.where(F.col("type").isin(*PRINCIPAL)).select(F.col("record_id").alias("other"), F.lit(True).alias("main"))
    links = records.select("record_id", F.explode("concurrent_to").alias("other"))
    edges = links.unionByName(links.select(F.col("other").alias("record_id"), F.col("record_id").alias("other"))).distinct()
    side = edges.join(main.withColumnRenamed("other", "record_id"), "record_id", "left_anti")
    direct = side.join(main, "other", "left_semi").groupBy("record_id").agg(F.min("other").alias("capture"))
    through = side.join(direct.withColumnRenamed("record_id", "other"), "other").select("record_id", "capture", F.lit(2).alias("steps"))
    ways = direct.withColumn("steps", F.lit(1)).unionByName(through)
    return ways.groupBy("record_id").agg(F.min(F.struct("steps", "capture"))["capture"].alias("capture"))


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: the principal record's columns, ``request`` and ``metadata`` (record_id, target_uri,
    fields; null without one), ``n_requests`` and ``n_metadata``. Whoever doesn't use ``payload`` doesn't shuffle it."""
    main = records.where(F.col("type").isin(*PRINCIPAL)).drop("concurrent_to", "fields")
    side = records.where(~F.col("type").isin(*PRINCIPAL)).select("record_id", "type", "target_uri", "fields").join(_captures_of(records), "record_id")
    for kind, name, count in (("request", "request", "n_requests"), ("metadata", "metadata", "n_metadata")):
        one = side.where(F.col("type") == kind).groupBy("capture").agg(F.min(F.struct("record_id", "target_uri", "fields")).alias(name), F.count("*").alias(count))
        main = main.join(one.withColumnRenamed("capture", "record_id"), "record_id", "left").withColumn(count, F.coalesce(count, F.lit(0).cast("long")))
    return main


def unattached(records: DataFrame) -> DataFrame:
    """Records that belong to no capture."""
    return records.where(~F.col("type").isin(*PRINCIPAL)).join(_captures_of(records), "record_id", "left_anti")


def field(fields: Column, name: str) -> Column:
    """A value of an application/warc-fields block; null if it isn't there."""
    found = F.regexp_extract(fields, rf"(?m)^{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def resolve(captures: DataFrame, identity: Column) -> DataFrame:
    """``captures`` with ``refers_to``, ``full_bytes`` and ``full_sha1``: for a revisit the response that holds its payload,
    told by ``identity``, and that payload's figures; for others null and their own figures."""
    told = captures.withColumn("own", identity).withColumn("digest", F.when(F.col("type") == "revisit", F.regexp_replace("declared_digest", "^sha1:", "")).otherwise(F.col("payload_sha1")))
    kept = told.where("type != 'revisit'").groupBy("digest").agg(F.max(F.struct("own", "payload_bytes")).alias("kept"))
    first = told.where("type != 'revisit'").withColumn("refers_to", F.lit(None).cast(told.schema["own"].dataType)).withColumn("full_bytes", F.col("payload_bytes")).withColumn("full_sha1", F.col("payload_sha1"))
    again = told.where("type = 'revisit'").join(kept, "digest", "left").withColumn("refers_to", F.col("kept.own")).withColumn("full_bytes", F.col("kept.payload_bytes")).withColumn("full_sha1", F.when(F.col("kept").isNotNull(), F.col("digest"))).drop("kept")
    return first.unionByName(again).drop("own", "digest")
