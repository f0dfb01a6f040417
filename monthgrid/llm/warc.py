"""WARC archives: one gzip member for each record, and a sequential reader.

Writing: pages with equal payloads of at least `min_revisit` bytes keep one response, the smallest id; the
others become revisits of it.  The grouping is by payload digest with partial minimums and a join that AQE can
split, so a payload that a third of the pages share loads no single task.  Segments of whole gzip members of
about `segment_bytes` go out through Spark's text writer, hence to any file system Spark can write: the writer
puts one zero byte after each segment, and each segment is cut before its own last byte, which is zero (the
length trailer of a member under 16 MB; after a larger one an empty member is added).

Reading: every file under the path is an archive, whatever its name (but for names that begin with a dot or an underscore, which Spark never
reads).  One of up to `whole_bytes` comes as a binary row; a streaming inflater hands over one member at a time, the record header
gives the length of its block, and block and payload digests are computed again.  A larger one must be named *.gz: it is
inflated by Spark as it is read and comes in pieces that end with line feeds, so that of an archive of any size only the record
at hand is held; records are then framed by their content length alone.

Defined results: null html is an empty payload; a very long payload is one record, held whole by the task that writes or reads it; records under the bound are all responses; rows that repeat the
smallest id are responses alike; rows without an id are written, but nothing refers to them; a null or odd URL
is percent-encoded or left out; an empty table makes an archive without records; other columns are not read, whatever their
names (`with_revisits` passes them on, but for its own three, which are replaced); a file that is no archive is an error.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtools import shared_dir, small_batches, spare

MIN_REVISIT = 100
SEGMENT_BYTES = 4 << 20
SCHEMA = (
    "record_id string, record_type string, target_uri string, refers_to string, payload_bytes bigint, "
    "payload_digest string, digest_ok boolean, payload binary"
)


def with_revisits(pages: DataFrame, *, page_id: str = "page_id", html: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """pages with __payload, __digest and __first: the id of the response that a revisit stands for, else null."""
    payload = F.coalesce(F.encode(F.col(html), "utf-8"), F.lit(b""))
    key, least = spare([*pages.columns, "__payload", "__digest", "__first"], "__key", "__least")
    made = pages.withColumn("__payload", payload).withColumn("__digest", F.sha2("__payload", 256))
    same = (
        pages.select(F.col(page_id).alias("id"), payload.alias("p")).filter(F.octet_length("p") >= min_revisit)
        .select("id", F.sha2("p", 256).alias("d")).groupBy("d")
        .agg(F.min("id").alias(least), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("d").alias(key), least)
    )
    first = F.when(F.col(least).isNotNull() & ~made[page_id].eqNullSafe(F.col(least)), F.col(least))
    return made.join(same, F.col("__digest") == F.col(key), "left").withColumn("__first", first).drop(key, least)


def member(kind: str, record: str, uri: str | None, refers: str | None, date: str, payload: bytes, digest: str) -> bytes:
    """One record as one gzip member."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if kind == "response":
        block += payload
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record}>"), ("WARC-Date", date)]
    head += [("WARC-Target-URI", uri)] if uri else []
    if refers:
        head += [("WARC-Refers-To", f"<{refers}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head += [
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return gz(text.encode() + block + b"\r\n\r\n")


def gz(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def safe_uri(url: str | None) -> str | None:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url) if url else None


def write_warc(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = MIN_REVISIT, date: str = "2024-01-01T00:00:00Z", segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write a record for each row of pages into archives under `path`."""
    small_batches(pages.sparkSession)

    def segments(batches):
        open_, size = [], 0

        def close():
            data = b"".join(open_)
            data = data if data.endswith(b"\0") else data + gz(b"")
            return pa.RecordBatch.from_arrays([pa.array([data[:-1]], pa.binary())], names=["data"])

        for batch in batches:
            ids, urls, first, digests = (batch.column(i).to_pylist() for i in range(4))
            for k in range(batch.num_rows):
                payload = batch.column(4)[k].as_py()
                kind = "response" if first[k] is None else "revisit"
                refers = None if first[k] is None else f"urn:page:{first[k]}"
                record = member(kind, f"urn:page:{'' if ids[k] is None else ids[k]}", safe_uri(urls[k]), refers, date, payload, digests[k])
                open_.append(record)
                size += len(record)
                if size >= segment_bytes:
                    yield close()
                    open_, size = [], 0
        if open_:
            yield close()

    rows = with_revisits(pages, page_id=page_id, html=html, min_revisit=min_revisit)
    rows = rows.select(F.col(page_id).cast("string"), F.col(url).cast("string"), F.col("__first").cast("string"), "__digest", "__payload")
    out = rows.mapInArrow(segments, "data binary").select(F.col("data").cast("string").alias("value"))
    out.write.option("lineSep", "\0").option("maxRecordsPerFile", 4).text(path)


def members(chunks):
    """The inflated gzip members of a byte stream, one after another."""
    z, parts, fresh = zlib.decompressobj(31), [], True
    for chunk in chunks:
        while chunk:
            parts.append(z.decompress(chunk))
            fresh = False
            chunk = z.unused_data
            if z.eof:
                yield b"".join(parts)
                z, parts, fresh = zlib.decompressobj(31), [], True
    if not fresh:
        raise ValueError("the archive ends inside a record")


def parse(record: bytes) -> dict:
    """A record's headers, framed block and checked payload."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a record: {lines[0][:40]!r}")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a block doesn't have the length that its record states")
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha256:")
    ok = fields.get("warc-block-digest", "") == f"sha256:{hashlib.sha256(block).hexdigest()}"
    if kind == "response":
        ok = ok and stated == len(payload) and digest == hashlib.sha256(payload).hexdigest()
    return {
        "record_id": fields["warc-record-id"].strip("<>"), "record_type": kind, "target_uri": fields.get("warc-target-uri"),
        "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
        "payload_bytes": stated, "payload_digest": digest, "digest_ok": ok, "payload": payload if kind == "response" else None,
    }


def records(lines):
    """The records of a stream of pieces that each lack the line feed at their end: the blank line after the header, then as
    many bytes as the header says, then the record's own end."""
    held, size, need, body = [], 0, None, 0
    for line in lines:
        if not held and line.strip() == b"":
            continue  # between records, or after an empty member
        held.append(line)
        size += len(line) + 1
        if need is None and line in (b"\r", b""):
            head = b"\n".join(held).decode(errors="replace").lower()
            found = [x.partition(":")[2].strip() for x in head.split("\r\n") if x.startswith("content-length:")]
            if not found:
                raise ValueError("a record without a content length")
            need, body = int(found[0]) + 4, size
        if need is not None and size - body >= need:
            yield b"\n".join(held) + b"\n"
            held, size, need = [], 0, None
    if held:
        raise ValueError("the archive ends inside a record")


SCHEMA_ARROW = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("digest_ok", pa.bool_()), ("payload", pa.binary())])


def rows_of(found, payloads: bool):
    """Batches of parsed records, of 2,000 of them or 4 MB of payloads."""
    rows, held = [], 0
    for record in found:
        row = parse(record)
        row["payload"] = row["payload"] if payloads else None
        rows.append(row)
        held += len(row["payload"] or b"")
        if len(rows) >= 2000 or held > 4 << 20:
            yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA_ARROW)
            rows, held = [], 0
    yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA_ARROW)


#: The largest archive that comes as one row.
WHOLE_BYTES = 64 << 20


def read_warc(spark, path: str, *, payloads: bool = True, chunk: int = 1 << 16, pattern: str | None = None, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """A row for each record of the archives under `path` (of those whose names match `pattern`, if one is given); `digest_ok`
    tells whether its digests hold."""

    def whole(batches):
        for batch in batches:
            for file in batch.column(0):
                data = memoryview(file.as_buffer())
                yield from rows_of((r for r in members(data[i : i + chunk] for i in range(0, len(data), chunk)) if r), payloads)

    def pieces(batches):
        # A file's lines follow one another in a task; the next file begins where the name changes.
        def lines():
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())

        for _, own in groupby(lines(), key=lambda x: x[0]):
            yield from rows_of(records(line for _, line in own), payloads)

    def options(reader):
        reader = reader.option("recursiveFileLookup", "true")
        return reader.option("pathGlobFilter", pattern) if pattern else reader

    files = options(spark.read.format("binaryFile")).load(path)
    sizes = files.select("path", "length")
    out = files.filter(F.col("length") <= whole_bytes).select("content").mapInArrow(whole, SCHEMA)
    large = [r["path"] for r in sizes.filter(F.col("length") > whole_bytes).collect()]  # a name for each archive that is too large for a row
    if large:
        if plain := [p for p in large if not p.endswith(".gz")]:
            raise ValueError(f"an archive of over {whole_bytes} bytes must be named *.gz: {plain[0]}")
        text = spark.read.option("lineSep", "\n").text(large).select(F.col("_metadata.file_path"), F.col("value").cast("binary"))
        out = out.unionByName(text.mapInArrow(pieces, SCHEMA))
    return out


def op8(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    number = lambda c: F.nullif(F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1), F.lit("")).cast("bigint")
    return read_warc(spark, path, payloads=False).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "digest_ok"
    )


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
f AS (SELECT html, min(page_id) AS least FROM p WHERE n >= {MIN_REVISIT} GROUP BY html)
SELECT page_id, n AS payload_bytes, sha256(p.html) AS payload_digest,
       CASE WHEN least IS NOT NULL AND least <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN least <> page_id THEN least END AS refers_to, TRUE AS digest_ok
FROM p LEFT JOIN f ON p.html = f.html
"""
