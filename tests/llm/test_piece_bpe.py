"""Encoding and decoding against the sentencepiece library."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from creditlake.llm import piece_bpe
from creditlake.llm.queries import QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def bpe():
    return piece_bpe.PieceBpe(MODEL)


def test_random_texts(sp, bpe):
    rnd = random.Random(9)
    pools = ["ab ", "the rain in Spain, it's 12.5% (of) \n\t", "aeiou st ", "▁ a_b-c", "éèüñß çà l'", "日本語 テスト、", "\U0001F600​\x00\r힣 ﬁ①",
             "".join(bpe.id_of)[:4000]]
    for k in range(4000):
        t = "".join(rnd.choice(rnd.choice(pools)) for _ in range(rnd.randint(0, 40)))
        ids = sp.encode(t)
        assert bpe.encode(t) == ids, t
        assert bpe.decode(ids) == sp.decode(ids), t
    for n in range(70):
        for t in (" " * n, "a" * n, " " * n + "the", "the" + " " * n + "x", "=" * n, "\n" * n, "abc" * n):
            assert bpe.encode(t) == sp.encode(t) and bpe.decode(sp.encode(t)) == sp.decode(sp.encode(t)), t


def test_long_runs(sp, bpe):
    rnd = random.Random(1)
    for t in ("a" * 20000, "".join(rnd.choice("abc") for _ in range(20000)), " " * 5000, "é" * 9999, "①" * 999):
        assert bpe.encode(t) == sp.encode(t)


def test_any_ids_decode(sp, bpe):
    rnd = random.Random(2)
    for _ in range(2000):
        ids = [rnd.choice((rnd.randrange(3, 259), rnd.randrange(3, 32000))) for _ in range(rnd.randint(0, 12))]
        assert bpe.decode(ids) == sp.decode(ids), ids


def test_merge_is_the_definition(sp, bpe):
    for t in ("▁hello", "▁unbelievable", "▁the", "ing", "ationally"):
        assert bpe.merge(t) == [bpe.pieces[i] for i in bpe.segment(t)]


def test_compatible_is_merging_again(bpe):
    """Undoing merges at the seam gives what merging the two pieces gives."""
    rnd = random.Random(4)
    pieces = list(bpe.rank)
    ends = {}
    for p in pieces:
        ends.setdefault(p[0], []).append(p)
    tried = 0
    for _ in range(6000):
        a = rnd.choice(pieces)
        b = rnd.choice(ends[rnd.choice(pieces)[rnd.randrange(1) - 1]] if rnd.random() < 0.5 else pieces) if a[-1] not in ends or rnd.random() < 0.5 \
            else rnd.choice(ends[a[-1]])
        if bpe.merge(a) == [a] and bpe.merge(b) == [b]:
            tried += 1
            assert bpe._compatible(bpe.id_of[a], bpe.id_of[b]) == (bpe.merge(a + b) == [a, b]), (a, b)
    assert tried > 3000
    assert all((bpe.merge(p) == [p]) == (len(p) == 1 or bpe.made(bpe.id_of[p]) is not None) for p in rnd.sample(pieces, 2000))


def test_slices(sp, bpe, monkeypatch):
    """Texts are cut into slices and units alike at any size of a slice."""
    import pyarrow as pa
    from creditlake.llm import units
    texts = [None, "", " ", "a b", "  x  y ", "▁ odd▁mark ", "long " * 500, "a\nb c", "é è"]
    for most in (1, 50, 1 << 21):
        monkeypatch.setattr(units, "SLICE_BYTES", most)
        ids = []
        for _, run in units.slices(pa.array(texts, pa.string())):
            found, values = bpe.units(run)
            flat, end = found.joined(values, "i4")
            ids += [flat[i:j].tolist() for i, j in zip(end[:-1], end[1:])]
            assert [t[1:].decode() for t in found.texts(*bpe.unit_texts(values))] == [sp.decode(x) for x in ids[-len(run):]]
        assert ids == [sp.encode(t or "") for t in texts]


def test_query(spark, sp):
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = QUERIES["op8_piece_bpe"](spark, d).collect()
    assert len(rows) == len(texts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows:
        ids = sp.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))


def test_edges(spark, sp, edge_docs):
    got = piece_bpe.encode(edge_docs, MODEL, keep=("doc_id", "extra"), decoded=True).collect()
    texts = {r.doc_id: r.text or "" for r in edge_docs.collect()}
    assert len(got) == edge_docs.count()
    assert all(r.ids == sp.encode(texts[r.doc_id]) and r.decoded == sp.decode(r.ids) for r in got)
    back = piece_bpe.decode(piece_bpe.encode(edge_docs, MODEL), MODEL).collect()
    assert sorted((r.doc_id, r.text) for r in back) == sorted((r.doc_id, r.decoded) for r in got)
    assert piece_bpe.encode(edge_docs.limit(0), MODEL).count() == 0
