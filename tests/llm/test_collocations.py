import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from creditlake.llm import collocations


def brute(rows, least, share=80, top=2000):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        text = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, 5):
                counts.update((lang, *words[i:i + k]) for i in range(len(words) - k + 1))
    out = {}
    kept = {p: n for p, n in counts.items() if n >= least}
    outer = Counter()
    for (lang, *w), n in kept.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                outer[lang, *w[i:i + k]] = max(n, outer[lang, *w[i:i + k]])
    for (lang, *w), a in kept.items():
        if len(w) < 2 or 100 * outer[lang, *w] >= share * a:
            continue
        cut = min((2000000 * a // (counts[lang, *w[:k]] + counts[lang, *w[k:]]), k) for k in range(1, len(w)))
        l, r = counts[lang, *w[:cut[1]]], counts[lang, *w[cut[1]:]]
        out.setdefault(lang, []).append((-cut[0], -a, " ".join(w).encode(), l, r))
    return sorted((lang, i, p.decode(), -a, l, r, total[lang], -s)
                  for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1))


def got(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def texts():
    rnd = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)] + ["Ünï", "\U0001F600", "E.T", "tab\tbed", "nul\0l"]
    rows = []
    for _ in range(600):
        words = [rnd.choice(vocabulary[:int(2 + 60 * rnd.random() ** 3)]) for _ in range(rnd.randint(0, 40))]
        if rnd.random() < 0.3:
            words[3:3] = ["New", "york", "city", "Hall"][:rnd.randint(2, 4)]
        rows.append((rnd.choice(["en", "en", "fr", None, "und"]), rnd.choice([" ", "  ", " \t"]).join(words) + rnd.choice(["", "\n.", "a b,a b,c"])))
    # phrases of one document that the sample may well miss, and a very long piece
    rows += [("de", "rare pair of words here " * 31), ("de", "rare pair"), (None, None), ("fr", ""), ("fr", " \n .. "), ("xx", "a a a a " * 20_000)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 3) for i, (lang, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, w1 string, n int")


@pytest.mark.parametrize("chunk,bits", [(1 << 22, 1 << 26), (300, 1 << 9)])
def test_brute_force(spark, monkeypatch, chunk, bits):
    """Also with tiny chunks and a bitmap so full that it lets much through."""
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    monkeypatch.setattr(collocations, "FILTER_BITS", bits)
    monkeypatch.setattr(collocations, "BLOCK_KEYS", 1 << 20 if chunk > 300 else 500)
    rows = texts()
    assert got(collocations.mine(frame(spark, rows), least=12, top=50)) == brute(rows, 12, top=50)


def test_no_sample(spark, monkeypatch):
    """Nothing but words proposed: every phrase comes through border failures."""
    monkeypatch.setattr(collocations, "propose", lambda chunked, tokens, words, least: words)
    rows = texts()
    assert got(collocations.mine(frame(spark, rows), least=12)) == brute(rows, 12)


def test_empty_table(spark):
    assert collocations.mine(frame(spark, [])).count() == 0
    assert collocations.mine(frame(spark, [("en", None), (None, "once only")])).count() == 0


def test_score_passes_64_bits(spark):
    a = spark.sql("select cast(9000000000000000 as bigint) a, cast(9100000000000000 as bigint) l, cast(9200000000000000 as bigint) r")
    assert a.select(collocations.score("a", "l", "r")).first()[0] == 2000000 * 9 * 10**15 // (91 * 10**14 + 92 * 10**14)


def test_filter_is_a_set(spark):
    keys = np.array([5 << 50, 7 << 50, 2**63, 2**64 - 1], np.uint64)
    df = spark.createDataFrame([(int(k),) for k in keys[[0, 2, 3]].view(np.int64)], "key long")
    bits = collocations.Proposals(spark).plus(df).bits
    assert collocations._has(bits, keys).tolist() == [True, False, True, True]
    assert np.bitwise_count(bits).sum() == 3


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    for keys in ([0], [2**64 - 1], np.unique(rng.integers(0, 2**64, 5000, np.uint64)), np.arange(9)):
        keys = np.array(keys, np.uint64)
        n = rng.integers(1, 2**32, len(keys))
        got, m = collocations._unpacked(collocations._packed(keys, n))
        assert (got == keys).all() and (m == n).all()
    keys, n = collocations._summed([np.array([3, 5], np.uint64), np.array([5, 9], np.uint64)], [np.array([1, 2]), np.array([10, 20])])
    assert keys.tolist() == [3, 5, 9] and n.tolist() == [1, 12, 20]


def test_phrase_with_a_shared_bit_is_counted_once():
    """The bit of "a a a" is set in the earlier bitmap by another phrase, that of
    "a a" is not: the earlier pass does not reach "a a a a", so the later one must."""
    word = np.array([0x1234_5678_9ABC_DEF1], np.uint64)
    two = collocations._join(word, word)
    three = collocations._join(two, word)

    def bitmap(*keys):
        bits = np.zeros(collocations.FILTER_BITS // 64, np.uint64)
        for key in keys:
            slot = key >> collocations._shift(64 * len(bits))
            bits[slot >> np.uint64(6)] |= np.uint64(1) << (slot & np.uint64(63))
        return bits
    codes, old, new = np.zeros(6, np.int32), bitmap(word, three), bitmap(word, two, three)
    places = [(order, int(at)) for bits in ((old, None), (new, old)) for order, spots, _ in collocations._phrases(word, codes, *bits)
              for at in spots]
    assert sorted(places) == [(order, at) for order in (2, 3, 4) for at in range(7 - order)]


def test_shuffles_hashes_not_words(spark, monkeypatch):
    """Words and phrases are named from the sampled chunks alone where these have
    them, and what a rare word is called never travels."""
    rows = [("en", f"common pair of words rare{k}") for k in range(400)] + [("de", "only here " * 40)]
    seen = []
    plain = collocations._named

    def named(exact, on, chunked, found):
        def noted(some, hot):
            out = found(some, hot)
            seen.append((on, out.count(), hot.count()))
            return out
        return plain(exact, on, chunked, noted)
    monkeypatch.setattr(collocations, "_named", named)
    assert got(collocations.mine(frame(spark, rows), least=30)) == brute(rows, 30)
    # at most two looks for each kind of key; a name comes once, and no rare word's does
    assert [on for on, _, _ in seen] == [["w"]] * 2 + [["order", "key"]] * 2
    assert all(met <= asked for _, met, asked in seen)


def test_chunks_hold_no_hashes_and_small_codes(spark):
    rnd = random.Random(3)
    words = [f"word{int(rnd.paretovariate(0.6)) % 30_000}" for _ in range(200_000)]
    text = " ".join(words[:150_000]) + ". " + " ".join(words[150_000:])
    chunked = collocations.chunks(spark.createDataFrame([("en", text)], "lang string, text string"))
    row = chunked.toArrow()
    stored = row.column("codes")[0]
    codes, known = collocations._codes(stored), row.column("words")[0].as_py()
    assert [known[c] if c >= 0 else None for c in codes] == [*words[:150_000], None, *words[150_000:]]
    assert Counter(words) == dict(zip(known, np.frombuffer(row.column("counts")[0].as_buffer(), np.int64).tolist()))
    found = spark.createDataFrame([("en", w) for w in known], "lang string, word string").selectExpr("xxhash64(lang, word) AS h").collect()
    assert collocations._hashes(row.column("hashes")[0]).view(np.int64).tolist() == [r.h for r in found]
    assert "hashes" not in spark.read.parquet(*chunked.inputFiles()).columns
    size = lambda b: len(collocations.zstandard.compress(b, 3))
    assert size(stored.as_py()) < 0.9 * size(codes.tobytes())


def test_codes_of_every_size():
    codes = np.array([-1, 0, 255, 256, 65535, 1 << 24, (1 << 31) - 2], np.int32)
    assert collocations._codes(pa.scalar(collocations._planes(codes))).tolist() == codes.tolist()
