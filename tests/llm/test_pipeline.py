"""Every stage against what its operator says of the stage's own input."""

import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from creditlake.llm import mixing, pii, quality_model, simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, frames = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], SF).write.parquet(f"{tmp_path}/{k}")
        frames.append(spark.read.parquet(f"{tmp_path}/{k}"))
        assert k == 4 or frames[-1].columns == columns
    raw, good, single, clean, mixed, coded = frames
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    assert ids(good) == ids(quality_model.classify(raw, labels).where("kept"))
    assert 0 < good.count() < raw.count()
    assert ids(single) == Counter({r.component_id: 1 for r in simhash.groups(good).collect()})
    assert ids(clean) == ids(single)
    before = {r.doc_id: r for r in single.collect()}
    for r in clean.collect():
        if r.text == before[r.doc_id].text:
            assert r == before[r.doc_id]
        else:
            assert r.n_chars == len(r.text) and "[" in r.text
    assert pii.find(clean).where(F.size(F.filter("pii", lambda s: s["kind"].isin("email", "ip", "card", "phone"))) > 0).count() == 0
    takes = {r.doc_id: r for r in mixing.mix(clean)[0].collect()}
    n = ids(mixed)
    assert all(n[d] == int(t.taken / t["size"] + 0.5) for d, t in takes.items())
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in mixed.collect()}
    assert ids(coded) == n
    for r in coded.collect():
        want = sp.encode(texts[r.doc_id])
        assert r.ids == want and r.n_tokens == len(want)
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(want).encode()).hexdigest()


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "ids" in out.columns


def test_stages_on_edges(spark, edge_docs, tmp_path):
    for table in (edge_docs, edge_docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, table, SF).count() >= 0
