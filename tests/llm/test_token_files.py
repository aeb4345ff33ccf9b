"""Ids against the tokenizers library; grammars and files by round trip."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from creditlake.llm import token_files as tf
from creditlake.llm.queries import QUERIES
from creditlake.session import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_library(lib):
    bpe = tf.ByteBpe(PATH)
    rnd = random.Random(3)
    pools = ["ab ", "it's we'll 12.5% (of) \n\t ", "éèü çà ", "日本 \U0001F600　\x85\x1c", " \n"]
    for _ in range(4000):
        t = "".join(rnd.choice(rnd.choice(pools)) for _ in range(rnd.randint(0, 40)))
        assert np.frombuffer(bpe.encode(t), np.uint32).tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)
    for t in ("a <|endoftext|> b", " x", "x ", "a  b", "don't", "a\n b", "a \nb"):
        assert np.frombuffer(bpe.encode(t), np.uint32).tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_grammar_round_trip():
    rnd = np.random.default_rng(0)
    for ids in ([], [5], [1] * 999, list(range(300)) * 9, rnd.integers(0, 6, 5000), rnd.integers(0, 50257, 3000),
                np.tile(rnd.integers(0, 400, 50), 200)):
        ids = np.array(ids, np.uint32)
        symbols, rules, size, first = tf.compress(ids, least=2)
        assert np.array_equal(tf.expand(symbols, rules, first), ids)
        for k in range(len(rules)):
            assert len(tf.expand(np.array([first + k], np.uint32), rules, first)) == size[k]
        for _ in range(20):
            a, b = sorted(rnd.integers(0, len(ids) + 1, 2))
            assert np.array_equal(tf.slice_ids(symbols, rules, size, first, int(a), int(b)), ids[a:b])
    symbols, rules, _, _ = tf.compress(np.tile(np.arange(50, dtype=np.uint32), 2000), rounds=6)
    assert len(symbols) + 2 * len(rules) < 100_000 / 10


def test_rounds_go_on_until_no_pair_is_frequent():
    rnd = np.random.default_rng(1)
    passage = rnd.integers(0, 50257, 1024)
    ids = np.concatenate([np.concatenate([passage, rnd.integers(0, 50257, 40)]) for _ in range(100)]).astype(np.uint32)
    symbols, rules, size, first = tf.compress(ids)
    assert np.array_equal(tf.expand(symbols, rules, first), ids)
    assert size.max() >= 512 and len(symbols) + 3 * len(rules) < len(ids) / 10
    pairs = np.unique(symbols[:-1].astype(np.uint64) << np.uint64(32) | symbols[1:], return_counts=True)[1]
    assert pairs.max() < tf.MIN_COUNT
    # more symbols than 16 bits hold
    ids = np.tile(rnd.permutation(50000).astype(np.uint32), 5)
    symbols, rules, size, first = tf.compress(ids)
    assert first + len(rules) > 1 << 16 and np.array_equal(tf.expand(symbols, rules, first), ids)
    assert len(symbols) < 100
    ids = np.zeros(4097, np.uint32)
    symbols, rules, size, first = tf.compress(ids)
    assert np.array_equal(tf.expand(symbols, rules, first), ids)


def want(docs, lib):
    out, start = [], 0
    for d, t in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4"))))
        start += len(ids)
    return out


def test_query(spark, lib):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = QUERIES["op9_token_files"](spark, d).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want(docs, lib)


def test_small_shards_and_edges(spark, lib, edge_docs):
    docs = [(r.doc_id, r.text) for r in edge_docs.collect()] + [(None, "no id")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    path = scratch_path(spark, "shards")
    tf.write(df, path, PATH, parts=3, shard_ids=50)
    got = sorted(map(tuple, tf.checksums(spark, path).collect()), key=lambda r: r[1])
    assert got == want(docs, lib)
    ids = {r.doc_id: r.ids for r in tf.read(spark, path).collect() if r.doc_id is not None}
    assert all(ids[d] == lib.encode(t or "", add_special_tokens=False).ids + [2] for d, t in docs if d is not None)
    path = scratch_path(spark, "shards")
    tf.write(df.limit(0), path, PATH)
    assert tf.checksums(spark, path).count() == 0
