"""Fingerprints and links against brute force over all pairs."""

import random
import re

import xxhash

from creditlake.llm import simhash as sh
from creditlake.llm.queries import QUERIES

from test_components import union_find


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def brute(docs):
    fp = [(d, plain(t)) for d, t in docs]
    edges = [(a, b) for a, x in fp for b, y in fp if a <= b and bin(x ^ y).count("1") <= 2]
    comp = union_find(edges)
    return sorted((d, f"{x:016x}", comp[d]) for d, x in fp)


def test_links_are_all_pairs(spark):
    rnd = random.Random(2)
    fps = {0, -1, 1 << 62, -(1 << 63)}
    for _ in range(60):
        x = rnd.getrandbits(64)
        for _ in range(6):
            y = x
            for b in rnd.sample(range(64), rnd.randint(0, 4)):
                y ^= 1 << b
            fps.add(y - (1 << 64) if y >> 63 else y)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for d in (1, 2, 3):
        got = {(r.a, r.b) for r in sh.links(df, d).collect()}
        assert got == {(a, b) for a in fps for b in fps if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= d}


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in QUERIES["op7_simhash"](spark, d).collect())
    assert got == brute(docs)


def test_edges_and_deduplicate(spark, edge_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
    got = sh.groups(edge_docs).collect()
    assert sorted((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in got) == brute(rows)
    assert sh.groups(edge_docs.limit(0)).count() == 0
    kept = sh.deduplicate(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute(rows)})
    nameless = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, "a b c"), (2, "a b c")], "doc_id long, text string")
    assert sorted((r.doc_id or 0) for r in sh.deduplicate(nameless).collect()) == [0, 0, 1]


def test_rows_of_one_id_stay_by_their_own_text(spark):
    text = "the quick brown fox jumps over the lazy dog near the river bank today"
    rows = [(1, "alpha beta gamma delta", "a", 1), (1, "completely other words stand here now", "b", 2), (2, text, "c", 3), (3, text, "d", 4),
            (None, text, "e", 5), (None, "only here and nowhere else at all", "f", 6), (2, text, "c", 3), (2, text, "b", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, tag int")
    kept = sh.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=lambda r: r[3]) == [rows[0], rows[1], rows[4], rows[5], rows[7]]
