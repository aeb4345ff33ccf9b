"""Measurements against plain Python, policies and ablations over the ledger."""

import random
import re
from collections import Counter

from creditlake.llm import quality_rules as qr


def plain(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + j for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in range(3)}
    return (len(w), sum(map(len, w)), sum(map(t.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(covered))


def test_measures(spark, edge_docs):
    rnd = random.Random(8)
    extra = [" ".join(rnd.choice("abcd") for _ in range(n)) for n in (2, 3, 4, 9, 40, 400)]
    extra += ["\n".join(rnd.choice(["x y", "", " ", "x y ", "\x0b"]) for _ in range(60)), "a#b|c <é> \U0001F600\x85 x", "a b " * 500]
    df = edge_docs.select("doc_id", "text", "kept").unionByName(
        spark.createDataFrame([(100 + i, t, 1) for i, t in enumerate(extra)], "doc_id long, text string, kept int"))
    texts = {r.doc_id: r.text for r in df.collect()}
    rows = qr.judge(df).collect()
    assert len(rows) == df.count()
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == plain(texts[r.doc_id]), texts[r.doc_id]
        assert r.base_failed == (got[0] < 50 or 100 * got[4] > 50 * got[0]) and (not r.base_failed or not r.kept)
    assert qr.judge(df.limit(0)).count() == 0


def test_policies_and_ablations(spark):
    good = " ".join(f"word{i}" for i in range(80))
    texts = [good, good.upper().replace("WORD", "ÀWORD"), " | ".join(good.split()), "x " * 300, "short", "# " * 100, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    led = qr.ledger(df).cache()
    failed = {r.doc_id: {n for n, b in qr.BIT.items() if r.failed & b} for r in led.collect()}
    assert failed[0] == set() and failed[1] == {"capital_ratio"} and "symbol_ratio" in failed[2]
    assert {"repeated_words", "word_length"} <= failed[3] and "few_words" in failed[4] and "few_words" in failed[6]
    policy = qr.Policy("test", 2, ("symbol_ratio", "few_words", "capital_ratio"))
    mine = {d: f & set(policy.rules) for d, f in failed.items()}
    assert {r.doc_id for r in led.where(qr.fails(policy)).collect()} == {d for d, f in mine.items() if f}
    for r in qr.ablations(led, policy).collect():
        assert r.policy == "test:2" and r.bit == qr.BIT[r.rule]
        assert r.n_failed == sum(r.rule in f for f in mine.values())
        assert r.n_only == sum(f == {r.rule} for f in mine.values())
        assert r.kept_without == sum(not f - {r.rule} for f in mine.values())
    every, any_ = ~0, 0
    for r in led.collect():
        every, any_ = every & r.failed, any_ | r.failed
    total = qr.failed_by(led).first()
    assert (total.n_docs, total.any_failed, total.all_failed) == (len(texts), any_, every)
