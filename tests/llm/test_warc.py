import base64
import gzip
import hashlib

import pytest

from creditlake.llm import warc
from creditlake.llm.queries import op11_warc_transactions
from tests.conftest import SF001

TRICKY = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/"
ROWS = [
    (5, "http://a.example/x?y#z", "<p>same</p>"), (2, "https://b.example", "<p>same</p>"), (9, None, "<p>same</p>"),
    (None, "http://c.example/", "<p>same</p>"), (4, "no host", ""), (3, "http://d.example/\r\nX: y", None), (7, "http://t.example/", TRICKY),
    (8, "http://t.example/2", "WARC/1.1\r\n\r\n"), (6, "http://l.example/", "ü" * 300_000), (6, "http://l.example/", "ü" * 300_000),
    (2, "https://b.example", "<p>same</p>"), (6, "http://other.example/", "x"),
]


def expected(rows, least=0):
    def key(r):
        return (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    out, first = [], {}
    for page, url, html in sorted(rows, key=key):
        raw = (html or "").encode()
        again = raw in first and len(raw) >= least
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response",
                    first[raw] if again else None))
        first.setdefault(raw, page)
    return sorted(out, key=repr)


def got(df):
    cols = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    pages = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "page_id long, url string, html string, sha string, nr int").repartition(4)
    assert got(warc.write_and_read(pages, least)) == expected(ROWS, least)


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write_and_read(pages).count() == 0


def test_whole_table(spark):
    pages = spark.read.parquet(f"{SF001}/pages.parquet")
    assert got(op11_warc_transactions(spark, SF001)) == expected([(r.page_id, r.url, r.html) for r in pages.collect()])


def test_payload_is_read_back(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"))
    records = warc.read(spark, str(tmp_path / "w"), payload=True)
    found = {r.payload.decode() for r in records.where("type = 'response'").collect()}
    assert found == {r[2] or "" for r in ROWS}
    assert records.where("digest is not null and digest <> payload_digest or truncated").count() == 0
    # plain gzip files of whole records, each ended by two line ends
    raw = b"".join(gzip.open(f).read() for f in sorted((tmp_path / "w").glob("*.gz")))
    assert raw.endswith(b"\r\n\r\n") and raw.count(b"WARC-Record-ID") == 3 * len(ROWS)


def record(kind, ident, block, *lines, length=None):
    head = [f"WARC/1.0\r\nWARC-Type: {kind}", f"WARC-Record-ID: <{ident}>", *lines, f"Content-Length: {len(block) if length is None else length}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_foreign_archive(spark, tmp_path):
    """Members of their own, records in any order, chains and both directions of
    concurrent-to, folded and repeated lines, bytes that are no UTF-8, strays, a cut end."""
    parts = [
        record("warcinfo", "i", b"software: x\r\n"),
        record("metadata", "m2", b"via: q\r\n", "WARC-Concurrent-To: <q1>"),
        record("request", "q1", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http;\r\n msgtype=request", "WARC-Concurrent-To: <r1>"),
        record("response", "r1", b"HTTP/1.1 200 OK\r\n\r\n\xff\xfe\x00", "Content-Type: application/http; msgtype=response"),
        record("metadata", "m1", b"page-id: 3\r\n"),
        record("response", "r2", b"HTTP/1.1 200 OK\r\n\r\nx", "Content-Type: application/http", "WARC-Concurrent-To: <m1>", "WARC-Concurrent-To: <q2>"),
        record("request", "q3", b"GET /", "WARC-Concurrent-To: <gone>"),
        record("response", "r3", b"HTTP/1.1 200 OK\r\n\r\nhalf", "Content-Type: application/http", length=999),
    ]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    records = warc.read(spark, str(tmp_path)).cache()
    assert [r.id for r in records.where("truncated").collect()] == ["<r3>"]
    whole = {r.capture: r for r in warc.assemble(records).collect()}
    assert set(whole) == {"<r1>", "<r2>", "<r3>"}
    assert [m.id for m in whole["<r1>"].metadata] == ["<m2>"] and [q.id for q in whole["<r1>"].requests] == ["<q1>"]
    assert [m.id for m in whole["<r2>"].metadata] == ["<m1>"] and whole["<r2>"].requests == []
    assert whole["<r1>"].response.payload_digest == base64.b32encode(hashlib.sha1(b"\xff\xfe\x00").digest()).decode()
    assert whole["<r3>"].requests is None and whole["<r3>"].response.truncated
    assert {r.id for r in warc.strays(records).collect()} == {"<i>", "<q3>"}
    records.unpersist()
