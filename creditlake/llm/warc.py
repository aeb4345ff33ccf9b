"""WARC archives: writing captures, reading records back, and assembling the
records of a capture into one row.

*Writing.*  A capture has three records: the response (or a revisit, if an
earlier capture has the same payload), the request and a metadata record; the
last two name the first by WARC-Concurrent-To.  All of a record is UTF-8 text
and every record ends with two line ends, so Spark's text writer with that line
separator writes valid gzip WARC files and its committer makes them safe
against lost executors.  A payload is shuffled once, after copies were dropped
where they were read; the other captures with this payload travel as keys.

*Reading.*  A gzip file is read by one task from its start to its end, cut at
the end of a record followed by the next version line.  Payloads may hold that
sequence, so the length in a record's header decides: pieces are joined until
the block is whole.  A task holds one record at a time.

*Assembly.*  Identifiers link the records: in each step, the records that have
no capture yet and are concurrent to one that has (in either direction) join
it; steps go on until none is left or none joins.  Revisits are joined to the
response that they refer to.

Defined cases: a null html is an empty payload; a null url has no target
header; line ends in a url are percent-encoded; a null page_id comes last among
equal payloads and stays null; rows equal in page_id, url and html are captures
of their own, numbered, and the first of them is the response; a very long
payload is one record, held by one task at a time; a payload may hold any text,
also what looks like a record; an empty table gives an empty archive; a record
that ends before its length is marked ``truncated``; records concurrent to
nothing known are left out of the captures (``strays`` returns them); other
columns of the pages are not read.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditlake.session import ensure_checkpoint_dir, scratch_path

CRLF = "\r\n"
#: what ends a record, and what parts two of them
END, CUT = CRLF * 2, CRLF * 2 + "WARC/"
VERSION = "WARC/1.1"
#: date of records whose pages have none
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http;msgtype="
#: rows per Arrow batch that a reader returns, and bytes of payloads in it
OUT_ROWS, OUT_BYTES = 2048, 1 << 24


def base32(hex40: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex: five hex digits are four of base 32."""
    parts = [F.lpad(F.upper(F.conv(F.substring(hex40, k, 5), 16, 32)), 4, "0") for k in range(1, 41, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _header(name: str, value: Column) -> Column:
    """A header line, nothing if it has no value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))


def _record(kind: Column | str, ident: Column, block: Column, content: Column | str | None = None, **headers: Column) -> Column:
    """Text of a record without its closing line ends."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [_header("WARC-Type", kind), _header("WARC-Record-ID", ident), _header("WARC-Date", F.lit(DATE))]
    lines += [_header(k.replace("_", "-"), v) for k, v in headers.items()]
    if content is not None:
        lines.append(_header("Content-Type", F.lit(content) if isinstance(content, str) else content))
    lines.append(_header("Content-Length", F.octet_length(block)))
    return F.concat(F.lit(VERSION + CRLF), *lines, F.lit(CRLF), block)


def _ident(kind: str, *parts: Column) -> Column:
    """A record identifier that a task run again makes again."""
    h = F.md5(F.to_json(F.struct(F.lit(kind).alias("kind"), *[p.alias(f"p{k}") for k, p in enumerate(parts)])))
    return F.concat(F.lit("<urn:uuid:"), *[x for k, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
                                           for x in ([F.lit("-")] if k else []) + [F.substring(h, a, n)]], F.lit(">"))


def captures_of(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> tuple[DataFrame, DataFrame]:
    """(payloads, captures): one row per distinct payload with the capture that
    is its response; one row per page with its number among equal rows, and the
    response of its payload."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha2("html", 256))
    order = F.struct(F.col("page_id").isNull().alias("late"), "page_id", F.col("url").isNull().alias("no_url"), "url")
    payloads = rows.groupBy("sha").agg(F.first("html").alias("html"), F.min(order).alias("top"))
    # the keys alone, without the html, for all captures
    light = rows.groupBy("page_id", "url", "sha").agg(F.count(F.lit(1)).alias("n"))
    light = light.join(rows.groupBy("sha").agg(F.min(order).alias("top")), "sha")
    captures = light.select("sha", "page_id", "url", "top", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("nr"))
    return payloads, captures


def write(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", html: str = "html",
          revisit_bytes: int = 0) -> None:
    """Write a transaction per page into the folder ``path``.  Payloads of
    fewer than ``revisit_bytes`` bytes are never revisited: each is a response."""
    ensure_checkpoint_dir(pages.sparkSession)
    payloads, captures = captures_of(pages, id_col, url, html)
    captures = captures.checkpoint()
    ident = lambda kind: _ident(kind, F.col("page_id"), F.col("url"), F.col("sha"), F.col("nr"))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    first = (F.col("page_id").eqNullSafe(F.col("top.page_id")) & F.col("url").eqNullSafe(F.col("top.url")) & (F.col("nr") == 1))

    def http(length: Column, body: Column) -> Column:
        return F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                        length.cast("string"), F.lit(CRLF * 2), body)

    def response(of: DataFrame) -> DataFrame:
        return of.select(_record(
            "response", ident("response"), http(F.octet_length("html"), F.col("html")), HTTP_TYPE + "response",
            WARC_Target_URI=uri, WARC_Payload_Digest=F.concat(F.lit("sha1:"), base32(F.sha1("html")))).alias("value"))

    heads = payloads.select("sha", "html", "top.page_id", "top.url", F.lit(1).cast("long").alias("nr"))
    records = [response(heads)]
    if revisit_bytes > 0:
        small = payloads.where(F.octet_length("html") < revisit_bytes).select("sha", "html")
        records.append(response(captures.where(~first).join(small, "sha")))
        captures = captures.join(small.select("sha", F.lit(True).alias("small")), "sha", "left")
    else:
        captures = captures.withColumn("small", F.lit(False))
    again = captures.where(~first & ~F.coalesce("small", F.lit(False)))
    records.append(again.select(_record(
        "revisit", ident("response"), F.lit(f"HTTP/1.1 200 OK{CRLF * 2}"), HTTP_TYPE + "response", WARC_Target_URI=uri,
        WARC_Profile=F.lit(PROFILE), WARC_Refers_To=_ident("response", F.col("top.page_id"), F.col("top.url"), F.col("sha"),
                                                           F.lit(1).cast("long"))).alias("value")))
    split = F.regexp_extract("url", r"^[^:/?#]*://([^/?#]*)([^#]*)", 1), F.regexp_extract("url", r"^[^:/?#]*://([^/?#]*)([^#]*)", 2)
    target = F.when(F.length(split[1]) > 0, split[1]).otherwise(F.lit("/"))
    asked = F.regexp_replace(F.concat(F.lit("GET "), F.coalesce(target, F.lit("/")), F.lit(" HTTP/1.1\nHost: "),
                                      F.coalesce(split[0], F.lit(""))), r"\r", "")
    asked = F.concat(F.replace(asked, F.lit("\n"), F.lit(CRLF)), F.lit(CRLF * 2))
    records.append(captures.select(_record("request", ident("request"), asked, HTTP_TYPE + "request", WARC_Target_URI=uri,
                                           WARC_Concurrent_To=ident("response")).alias("value")))
    fields = F.concat(_header("page-id", F.col("page_id")), _header("copy", F.col("nr")))
    records.append(captures.select(_record("metadata", ident("metadata"), fields, "application/warc-fields",
                                           WARC_Target_URI=uri, WARC_Concurrent_To=ident("response")).alias("value")))
    out = records[0]
    for r in records[1:]:
        out = out.unionByName(r)
    out.write.option("lineSep", END).option("compression", "gzip").text(path)


RECORDS = ("file string, type string, id string, uri string, date string, concurrent_to array<string>, refers_to string, "
           "digest string, payload_bytes long, payload_digest string, headers map<string,string>, truncated boolean")


def _lines(head: bytes) -> list[tuple[str, str]]:
    """(lower-case name, value) of header lines; folded lines continue a value."""
    found: list[tuple[str, str]] = []
    for line in head.split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and found:
            found[-1] = (found[-1][0], f"{found[-1][1]} {line.strip().decode('utf-8', 'replace')}")
        elif b":" in line:
            name, _, value = line.partition(b":")
            found.append((name.strip().decode("utf-8", "replace").lower(), value.strip().decode("utf-8", "replace")))
    return found


class _Reader:
    """Joins the pieces of a file to records."""

    def __init__(self, with_payload: bool):
        self.with_payload, self.file, self.have = with_payload, None, 0
        self.parts: list[bytes] = []
        self.need: int | None = None                              # bytes of the record, once its header is read

    def feed(self, file: str, piece: bytes):
        if file != self.file:
            yield from self.close()
            self.file = file
        if self.parts:
            self.parts += [CUT.encode(), piece]
            self.have += len(CUT) + len(piece)
        elif piece.strip():
            self.parts, self.need, self.have = [piece], None, len(piece)
        if self.parts and self.need is None:
            # a block that begins with "WARC/" was cut right after the header
            start = b"".join(self.parts)
            head = start.find(b"\r\n\r\n")
            if head >= 0:
                lengths = [v for n, v in _lines(start[:head]) if n == "content-length"]
                self.need = head + 4 + (int(lengths[0]) if lengths and lengths[0].isdigit() else 0)
        if self.parts and self.need is not None and self.have >= self.need:
            yield from self.close()

    def close(self):
        """The record held, whole or not."""
        if self.parts:
            whole = self.parts[0] if len(self.parts) == 1 else b"".join(self.parts)
            self.parts = []
            yield self._row(whole)

    def _row(self, whole: bytes) -> tuple:
        head, _, block = whole.partition(b"\r\n\r\n")
        named = _lines(head)
        get = dict(reversed(named)).get                           # of repeated names the first
        need = len(head) + 5 if self.need is None else self.need     # a header without its end is never whole
        block = block[:max(0, need - len(head) - 4)]
        kind, payload, n_bytes, digest = get("warc-type"), None, None, None
        if kind in ("response", "request", "resource", "conversion", "metadata"):
            payload = block
            if (get("content-type") or "").startswith("application/http"):
                payload = block.partition(b"\r\n\r\n")[2]
            n_bytes = len(payload)
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        told = [v for n, v in named if n == "warc-concurrent-to"]
        said = get("warc-payload-digest")
        row = (self.file, kind, get("warc-record-id"), get("warc-target-uri"), get("warc-date"), told, get("warc-refers-to"),
               said.rpartition(":")[2] if said else None, n_bytes, digest,
               [(n, v) for n, v in dict(reversed(named)).items()], len(whole) < need)
        # a metadata record's payload is its fields, always kept: it's what describes the capture
        return row + ((payload if self.with_payload or kind == "metadata" else None),)


def read(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """Every record of the gzip files in ``path``: header values, length and
    SHA-1 (base32) of the payload measured from the bytes read, and the
    ``payload`` itself of metadata records (of all records, if asked for)."""
    text = spark.read.option("lineSep", CUT).text(path)
    pieces = text.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))
    kinds = spark.createDataFrame([], RECORDS + ", payload binary").schema
    types = [pa.string()] * 5 + [pa.list_(pa.string()), pa.string(), pa.string(), pa.int64(), pa.string(),
                                 pa.map_(pa.string(), pa.string()), pa.bool_(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=kinds.names)

    def run(batches):
        reader, rows, held = _Reader(payload), [], 0

        def out(found):
            nonlocal rows, held
            for r in found:
                rows.append(r)
                held += len(r[-1] or b"")
                if len(rows) >= OUT_ROWS or held >= OUT_BYTES:
                    yield batch(rows)
                    rows, held = [], 0
        for b in batches:
            for file, piece in zip(b.column(0), b.column(1)):
                yield from out(reader.feed(file.as_py(), piece.as_py()))
        yield from out(reader.close())
        if rows:
            yield batch(rows)
    return pieces.mapInArrow(run, kinds)


HEADS = ("response", "revisit", "resource")


def _assigned(records: DataFrame) -> DataFrame:
    """(id, capture) of every record that belongs to a capture; checkpointed."""
    ensure_checkpoint_dir(records.sparkSession)
    links = records.select("id", F.explode("concurrent_to").alias("other"))
    links = links.unionByName(links.select(F.col("other").alias("id"), F.col("id").alias("other"))).where("id <> other").distinct()
    heads = records.where(F.col("type").isin(*HEADS)).select("id", F.col("id").alias("capture")).distinct()
    loose = records.where(~F.col("type").isin(*HEADS)).select("id").distinct().checkpoint()
    found, known = heads, heads
    while True:
        near = links.join(known.withColumnRenamed("id", "other"), "other").join(loose, "id", "left_semi")
        known = near.groupBy("id").agg(F.min("capture").alias("capture")).checkpoint()
        found = found.unionByName(known)
        loose = loose.join(known, "id", "left_anti").checkpoint()
        if known.isEmpty() or loose.isEmpty():
            return found


def strays(records: DataFrame) -> DataFrame:
    """Records that belong to no capture."""
    return records.join(_assigned(records), "id", "left_anti")


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: ``capture`` (id of its head), ``response`` (head
    record: type, uri, date, refers_to, digest, payload_bytes, payload_digest,
    truncated), ``requests`` and ``metadata`` (records concurrent to it, by id,
    with headers; metadata with ``payload``), ``original`` (the response that a
    revisit refers to: id and measured payload)."""
    own = _assigned(records)
    head = records.where(F.col("type").isin(*HEADS)).select(
        F.col("id").alias("capture"), F.struct("type", "uri", "date", "refers_to", "digest", "payload_bytes", "payload_digest",
                                               "truncated").alias("response"))
    others = (records.where(~F.col("type").isin(*HEADS)).join(own, "id")
              .groupBy("capture").agg(*[
                  F.sort_array(F.collect_list(F.when(F.col("type") == kind, F.struct("id", "uri", "payload_bytes", *extra)))).alias(name)
                  for kind, name, extra in (("request", "requests", ["payload_digest"]), ("metadata", "metadata", ["payload"]))]))
    whole = head.join(others, "capture", "left")
    original = (whole.where(F.col("response.type") == "response")
                .select(F.col("capture").alias("_refers_to"),
                        F.struct(F.col("capture").alias("id"), "response.payload_bytes", "response.payload_digest",
                                 "metadata").alias("original")))
    return whole.join(original, F.col("response.refers_to") == F.col("_refers_to"), "left").drop("_refers_to")


def field(metadata: Column, name: str) -> Column:
    """Value of a field in a capture's metadata records, the first that has it."""
    values = F.transform(metadata, lambda m: F.regexp_extract(
        F.concat(F.lit("\r\n"), m["payload"].cast("string")), rf"(?i)\r\n{name}: ([^\r\n]*)", 1))
    return F.get(F.filter(values, lambda v: v != ""), 0)


def write_and_read(pages: DataFrame, revisit_bytes: int = 0) -> DataFrame:
    """Write the pages' archives into a fresh folder below the session's shared
    checkpoint folder, read them back and return one row per capture: page_id,
    payload_bytes, payload_digest, record_type and refers_to (a page_id)."""
    spark = pages.sparkSession
    path, light = scratch_path(spark, "warc"), scratch_path(spark, "warc_records")
    write(pages, path, revisit_bytes=revisit_bytes)
    # header values and digests only: what the assembly's steps read again
    read(spark, path).drop("file", "headers").write.parquet(light)
    found = assemble(spark.read.parquet(light))
    page = lambda metadata: field(metadata, "page-id").try_cast("long")
    again = F.col("response.type") == "revisit"
    return found.select(
        page(F.col("metadata")).alias("page_id"),
        F.when(again, F.col("original.payload_bytes")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.when(again, F.col("original.payload_digest")).otherwise(F.col("response.payload_digest")).alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.when(again, page(F.col("original.metadata"))).alias("refers_to"), F.col("response.uri").alias("uri"))
