"""Perplexities against a plain Kneser-Ney model in dictionaries; held-out accuracy."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditlake.llm import quality_model as qm

N = qm.ORDER


class Plain:
    def __init__(self, texts):
        c = Counter(g for t in texts for g in self.grams(t))
        self.c = {N: c}
        for k in range(N - 1, 0, -1):
            self.c[k] = Counter(g[1:] for g in self.c[k + 1])
        self.d = {k: self.discounts(x) for k, x in self.c.items()}
        self.ctx = {}
        for k, x in self.c.items():
            self.ctx[k] = defaultdict(lambda: [0, 0.0])
            for g, n in x.items():
                s = self.ctx[k][g[:-1]]
                s[0] += n
                s[1] += self.d[k][min(n, 3)]

    @staticmethod
    def grams(t):
        t = "\n" * (N - 1) + t
        return [t[i:i + N] for i in range(len(t) - N + 1)]

    @staticmethod
    def discounts(x):
        n = Counter(min(v, 5) for v in x.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        out = {}
        for i in (1, 2, 3):
            raw = i - (i + 1) * y * n[i + 1] / n[i] if y is not None and n[i] else None
            out[i] = raw if raw is not None and 0 < raw < i else i / 2
        return out

    def p(self, g):
        p = 1 / (len(self.c[1]) + 1)
        for k in range(1, N + 1):
            h = g[N - k:]
            total, held = self.ctx[k].get(h[:-1], (0, 0.0))
            if total:
                n = self.c[k].get(h, 0)
                p = ((n - self.d[k][min(n, 3)] if n else 0.0) + held * p) / total
        return p

    def perplexity(self, t):
        return math.exp(-sum(math.log(self.p(g)) for g in self.grams(t)) / len(t))


@pytest.fixture(scope="module")
def table():
    rnd = random.Random(6)
    syll = {"en": ["the", "an", "ing", "er "], "xx": ["ça", "lé", "ou ", "\U0001F600"]}
    rows, labels = [], []
    for i in range(120):
        lang = rnd.choice(["en", "en", "xx", None, "zz"])
        t = "".join(rnd.choice(syll.get(lang, ["q", "w "])) for _ in range(rnd.randint(1, 60)))
        bad = i % 10 == 3
        rows.append((i, "".join(rnd.choice("#%$!ABCQ") for _ in range(50)) if bad else t, lang, "x", 5))
        if i % 2 and lang != "zz":
            labels.append((i, 0 if bad else 1, None if i % 3 else 0))
    rows += [(500, None, "en", None, None), (501, "", None, "x", 1), (7, rows[7][1], rows[7][2], "x", 5), (None, "the an", "en", "x", 1)]
    return rows, labels


def test_equals_plain_model(spark, table):
    rows, labels = table
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, extra string, perplexity int").repartition(3)
    labs = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = qm.classify(docs, labs, chunk_chars=700).collect()
    assert len(got) == len(rows)
    trusted = {d for d, q, t in labels if q == 1 and not t}
    held = {r.doc_id for r in docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(qm.HOLD_OUT)) == 0).collect()} & trusted
    trusted -= held
    models = {lang: Plain([t for d, t, la, *_ in rows if d in trusted and (la or "") == lang]) for lang in ("en", "xx", "")}
    want = sorted((d if d is not None else -1, models[la or ""].perplexity(t) if t and la != "zz" else 0) for d, t, la, *_ in rows)
    have = sorted((r.doc_id if r.doc_id is not None else -1, r.perplexity or 0) for r in got)
    assert [d for d, _ in have] == [d for d, _ in want]
    assert all(abs(a - b) <= 1e-5 * b for (_, a), (_, b) in zip(have, want))
    for r in got:
        if r.n_chars == 0:
            assert not r.kept and r.perplexity is None
        elif r.lang == "zz":
            assert r.kept and r.perplexity is None
        else:
            assert r.kept == (r.limit is None or r.perplexity <= r.limit)
    for lang in ("en", "xx", ""):
        ppl = sorted(r.perplexity for r in got if r.lang == lang and r.doc_id in held)
        limit = next(r.limit for r in got if r.lang == lang)
        assert (limit is None) == (not ppl)
        if not ppl:
            continue
        at = ppl[max(0, math.ceil(qm.QUANTILE * len(ppl)) - 1)]
        assert at <= limit / math.exp(qm.MARGIN) * (1 + 1e-9) <= at * math.exp(qm.BIN) * (1 + 1e-9)
    kept = qm.keep_good(docs, labs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.kept for r in qm.classify(docs, labs).collect())


def test_keys_of_many_characters():
    """More characters than ranks fit: the symbols are pairs."""
    import zstandard
    text = qm.PAD + "".join(map(chr, range(0x3400, 0xD7FF))) + "".join(map(chr, range(0x10000, 0x20000)))
    body = zstandard.ZstdCompressor().compress((text + qm.PAD + "abcab").encode())
    c = qm._Chunk({"body": body, "sizes": [len(text) - len(qm.PAD), 5]})
    assert c.span == 2
    keys, n = c.distinct()
    assert Counter(dict(zip(c.grams(keys), n))) == Counter(Plain.grams(text[3:]) + Plain.grams("abcab"))
    assert list(c.keys_of(c.grams(keys))) == list(keys)
    assert list(c.sums(keys, np.ones(len(keys)))) == [len(text) - 3, 5]


def test_edges(spark, edge_docs):
    labs = spark.createDataFrame([(8, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert qm.classify(edge_docs, labs).count() == edge_docs.count()
    assert qm.classify(edge_docs, labs.limit(0)).where("kept").count() == edge_docs.where("length(text) > 0").count()
    assert qm.classify(edge_docs.limit(0), labs).count() == 0


def test_held_out_accuracy(spark):
    """Trained on half of the labels: nearly all good documents of the other
    half stay, most bad ones go (repeated words look like their language)."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = labels.where("doc_id % 2 = 0").select("doc_id", "quality")
    r = qm.classify(docs, labels.where("doc_id % 2 = 1")).join(held, "doc_id")
    good, bad = (r.where(f"quality = {q}").agg(F.avg(F.col("kept").cast("int"))).first()[0] for q in (1, 0))
    assert good >= 0.985 and bad <= 0.3


def test_limit_is_the_quantile_itself(spark):
    scored = spark.createDataFrame([(i, "en", float(10 + i)) for i in range(1000)], "doc_id long, lang string, perplexity double")
    limit = qm.thresholds(scored, scored.select("doc_id")).first()["limit"]
    assert 1004 <= limit <= 1004 * math.exp(qm.BIN) * (1 + 1e-9)
