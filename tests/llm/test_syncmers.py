"""Closed syncmers against a plain enumeration; edits, neighbours and ties."""

import hashlib
import random

from pyspark.sql import functions as F

from creditlake.llm import syncmers as sy


def test_place_is_bisect(spark):
    import bisect
    for cuts in ([5], [1, 4, 9], list(range(0, 400, 7))):
        df = spark.range(-3, 420).select(F.col("id"), sy._place(F.col("id"), cuts).alias("p"))
        assert all(r.p == bisect.bisect_right(cuts, r.id) for r in df.collect())


def test_anchors_are_closed_syncmers(spark):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice("abcdefghijklmnop") for _ in range(n)) for n in (0, 1, 3, 4, 5, 40, 300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    inner = F.transform(sy.tokens(F.col("text")), lambda x, i: x)
    for r in df.select("i", sy.anchors(F.col("text")).alias("a"), inner.alias("w")).collect():
        w = r.w
        if len(w) < sy.K:
            assert len(r.a) == (1 if w else 0)
            continue
        pairs = sorted({(x, y) for x, y in zip(w, w[1:])})
        h = {(p.x, p.y): p.h for p in spark.createDataFrame(pairs, "x string, y string").select(
            "x", "y", F.xxhash64("x", "y").alias("h")).collect()}
        a = [h[p] for p in zip(w, w[1:])]
        want = [i for i in range(len(w) - 3) if min(a[i:i + 3]) in (a[i], a[i + 2])]
        assert [x.position for x in r.a] == want


def test_fingerprints_edit_and_next(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    rows = [(i * 3, " ".join(word() for _ in range(rnd.choice([0, 1, 5, 200, 900])))) for i in range(60)]
    rows += [(500, rows[7][1]), (501, None), (502, "é\U0001F600" * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in sy.fingerprints(df, parts=7).collect()}
    assert len(got) == len(rows)
    for j, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(j + 1) % len(rows)][1] or ""
        h = len(t) // 2
        edited = t[:len(t) - h] + nxt[:h]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        if len(t) > 2000 and len(nxt) > 2000:
            assert got[i].near_edited > 0.1 > got[i].near_next
    assert got[500].fingerprint == got[21].fingerprint


def test_edge_table(spark, edge_docs):
    got = sy.fingerprints(edge_docs, parts=4).collect()
    assert len(got) == edge_docs.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r)
    assert by[0].fingerprint == by[1].fingerprint == "" and by[0].near_edited == 1.0
    assert by[8].fingerprint == by[9].fingerprint
    assert sy.fingerprints(edge_docs.limit(0)).count() == 0
    one = sy.fingerprints(edge_docs.where("doc_id = 4")).first()
    assert one.near_next == 1.0


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (1, "x y z v w"), (None, None)], "doc_id long, text string")
    assert sy.fingerprints(df).count() == 3
