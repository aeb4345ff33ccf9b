"""Targets against repeated resharing, schedules and takes against their rules."""

import random
import re
from collections import Counter

from creditlake.llm import mixing
from creditlake.llm.queries import QUERIES


def reshare(sizes):
    """source sizes in order -> targets by giving out the excess again and again."""
    w = {s: i % 3 + 1 for i, s in enumerate(sizes)}
    cap = {s: 3 * n for s, n in sizes.items()}
    full, total = set(), sum(sizes.values())
    while True:
        rest = [s for s in sizes if s not in full]
        left = total - sum(cap[s] for s in full)
        t = {s: cap[s] if s in full else left * w[s] / sum(w[x] for x in rest) for s in sizes}
        over = {s for s in rest if t[s] > cap[s]}
        if not over:
            return t
        full |= over


def check(rows, docs):
    size = Counter()
    by_id = {}
    for d, t, s in docs:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        size[s] += n
        by_id.setdefault(d, []).append((n, s))
    order = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in size)
    want = reshare({s: size[s] for s in order})
    assert len(rows) == len(docs)
    taken = Counter()
    for r in rows:
        n, s = next(x for x in by_id[r.doc_id] if x[0] == r["size"])
        assert r.source_size == size[s] and abs(r.target - want[s]) <= 1e-9 * max(1, want[s])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[s] += r.taken
    for s in order:
        assert abs(taken[s] - want[s]) <= 1, (s, taken[s], want[s])


def test_skewed_sources(spark):
    rnd = random.Random(4)
    docs = [(i, " ".join("w" * rnd.randint(1, 3) for _ in range(rnd.choice([0, 1, 7, 300]))),
             rnd.choice(["hot"] * 60 + ["a", "b", "é", "zz", "Z", None])) for i in range(400)]
    docs += [(9999, None, "a"), (9998, "x", "tiny"), (3, "p q", "a"), (3, "p q", "a"), (9997, "", "none")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    rows = mixing.mix(df, block=16)[0].collect()
    check(rows, docs)
    again = mixing.mix(df.repartition(5), block=16)[0].collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_schedule_is_whole_and_even(spark):
    docs = [(i, "w " * 50, f"s{i % 5}") for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    plan = mixing.mix(df, block=8)[1].collect()
    n = len(plan)
    assert sorted(r.slot for r in plan) == list(range(n))
    assert len({(r["rank"], r.epoch, r.block) for r in plan}) == n
    share = Counter(r["rank"] for r in plan)
    # every prefix of the schedule has about each source's share
    seen = Counter()
    for i, r in enumerate(sorted(plan, key=lambda r: r.slot), 1):
        seen[r["rank"]] += 1
        for k, c in share.items():
            assert abs(seen[k] - i * c / n) <= 8


def test_edges(spark, edge_docs):
    rows = mixing.mix(edge_docs)[0].collect()
    assert len(rows) == edge_docs.count()
    assert mixing.mix(edge_docs.limit(0))[0].count() == 0
    blank = mixing.mix(edge_docs.where("doc_id < 3"))[0].collect()
    assert [r.taken for r in blank] == [0, 0, 0]


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    check(QUERIES["op2_source_mix"](spark, d).collect(), docs)
