"""Spans against a plain Python search, and validators on known values."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from creditlake.llm import pii
from creditlake.llm.queries import QUERIES

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub(r"\D", "", m)) <= 19 and _luhn(re.sub(r"\D", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub(r"\D", "", m)) <= 15),
]


def _luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    out = []
    for no, (kind, p, ok) in enumerate(BASE):
        out += [(m.start(), no, kind, m.end()) for m in re.finditer(p, text or "") if ok(m.group())]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


TEXTS = [
    None, "", "mail a.b+c@x-y.example.com, and a@b", "a@b.c_d@e.f g", "x@y.z.", "@@a@b.c@d.e",
    "ip 1.2.3.4 and 999.1.1.1 1.2.3.4.5 0001.0.0.255 1.2.3 256.1.1.1", "4111 1111 1111 1111 then 4111-1111-1111-1112",
    "é4111111111111111é +1 (017) 555-7713 rest +123 456", "+1+2+12345678901", "1" * 9000, "9" * 19, "a" * 20000 + "@",
    "\U0001F600 +49 30 901820-12.", "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" x",
    "IBAN DE89 3704 0044 0532 0130 00 and DE89 3704 0044 0532 0130 01", "my card 4111111111111112 ok",
    "call (555) 123-4567 or 555-123-4567", "ssn 123-45-6789 ok 123-45-6789",
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    base = F.filter("pii", lambda s: s["kind"].isin(*[k for k, _, _ in BASE]))
    return {r.doc_id: r for r in pii.find(df).select("*", pii.written(base).alias("base"), pii.written(F.col("pii")).alias("all"),
                                                     pii.redact(F.col("text"), F.col("pii")).alias("clean")).collect()}


def test_base_spans_equal_plain_search(found):
    for i, t in enumerate(TEXTS):
        assert found[i].base == brute(t), t


def test_added_spans(found):
    assert "secret:9:49" in found[14]["all"]
    assert found[15]["all"] == "iban:5:32"
    assert found[16]["all"] == "account:8:24"
    assert found[17]["all"] == "local_phone:5:19,local_phone:23:35"
    assert found[18]["all"] == "national_id:4:15,national_id:19:30"


def test_redaction(found):
    assert found[0].clean is None and found[1].clean == ""
    assert found[15].clean == "IBAN [IBAN] and DE89 3704 0044 0532 0130 01"
    assert found[4].clean == "[EMAIL]."
    for i, t in enumerate(TEXTS):
        if not found[i]["all"]:
            assert found[i].clean == t


def test_query_on_table(spark):
    d = "/root/testdata/sf0.001"
    rows = QUERIES["op10_pii"](spark, d).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        for k in ("email", "ip", "card", "phone"):
            assert r[f"n_{k}"] == want.count(k + ":")


def test_edge_table(edge_docs, spark):
    out = pii.find(edge_docs)
    assert out.count() == edge_docs.count() and set(edge_docs.columns) < set(out.columns)
    assert pii.find(edge_docs.limit(0)).count() == 0


def _context_brute(text):
    """Added kinds with a context word within the window of the whole text."""
    out = []
    for no, d in enumerate(pii.DETECTORS):
        if d.kind in ("local_phone", "national_id", "secret"):
            for m in re.finditer(d.pattern, text):
                a, b = max(m.start() - pii.CONTEXT_CHARS, 0), m.end() + pii.CONTEXT_CHARS
                if re.search(d.context, (text[a:m.start()] + "\n" + text[m.end():b]).lower()):
                    out.append((m.start(), no, d.kind, m.end()))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def test_context_window_is_of_the_whole_text(spark):
    texts = ["ssn 123-45-6789 ok 123-45-6789", "tel: 555-123-4567, 555-987-6543", "123-45-6789 (SSN)",
             "ssn 000-12-3456, 123-45-6789", "token " + "a1" * 100, "ssn " + "x" * 37 + " 123-45-6789",
             "123-45-6789 " + "\U0001F600" * 35 + " ssn", "123-45-6789 " + "\U0001F600" * 36 + " ssn",
             "ssn\n123-45-6789 " * 30, "555-123-4567\n(phone) 555-987-6543"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r["all"] for r in pii.find(df).select("doc_id", pii.written(F.col("pii")).alias("all")).collect()}
    assert got[0] == "national_id:4:15,national_id:19:30"
    assert got[1] == "local_phone:5:17,local_phone:19:31"
    assert got[2] == "national_id:0:11" and got[4] == "secret:6:206"
    for i, t in enumerate(texts):
        if i != 3:
            assert got[i] == _context_brute(t), t
    assert got[3] == "national_id:17:28"
