"""Phrases of up to four words that stand together more often than apart, mined
by Toivonen's method.

*Chunks.*  One scan lower-cases A-Z, cuts texts into pieces and words and stores
them as chunks of one language: the distinct words with their counts, and the
text as numbers of these.  All later passes read the chunks.  Words are counted
from the chunks' own counts, by their hashes.

*Sample.*  A quarter of the documents (by a hash), mined level by level with a
lowered threshold, proposes phrases of the frequent words.

*Full pass.*  Counts, over all chunks, every phrase whose two parts (without its
last word, without its first) are proposed: these are the proposed phrases and
their negative border.  Phrases that the sample missed and that turn out
frequent are border failures: they join the proposals, and a further pass counts
the phrases that this makes possible, until a pass finds no failure.  A frequent
phrase has frequent parts, so none is missed then.

*Membership.*  The proposals are known to the tasks as one bitmap of
``FILTER_BITS`` bits at any size of the input.  Two phrases may share a bit; then
a phrase too many is counted.  A phrase is counted in the first pass whose
bitmap has both of its parts, so never twice.

*Exact counts.*  The passes add up hashes of phrases, where they are found and
then over all tasks; hashes travel sorted, as packed differences, in blocks by
range, with a number of bits and of ranges that grow with the corpus.  A shared
hash can only raise a sum, so what stays below the threshold is infrequent for
certain; the few others are counted a last time by their whole hashes.

*Names.*  What a frequent hash stands for is read from the sampled chunks, once
for each task, and only what these lack from the others.

A word is a 64-bit hash (of its language and itself) until the end, a phrase a
tuple of those.

Defined cases: a null text is empty; a null language is ``und``; empty and very
long texts are read whole (a piece is never cut); repeated rows count each time;
equal scores are ordered by count, then phrase; an empty table has no phrase;
other columns, of any name, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from creditlake.session import ensure_checkpoint_dir, scratch_path

from .columns import LARGE_ROWS

#: bytes of text of a chunk, if its pieces are not longer
CHUNK = 1 << 22
#: one document in so many is sampled; the sample's threshold is lowered to
#: this share of what it should hold
SAMPLE, LOWERED = 4, 0.5
#: bits of the bitmap of proposals (8 MB)
FILTER_BITS = 1 << 26
MOST_WORDS = 4
#: rows per Arrow batch that a pass returns
OUT_ROWS = 1 << 16
#: hashes that a task holds before it packs them, and about as many as a range has
BLOCK_KEYS = 1 << 20
#: lower-cases A-Z, makes ends of pieces 0xFF (no byte of UTF-8) and tabs spaces
_BREAK = b"\xff"
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + _BREAK * 10 + b" ")
CHUNKS = "lang string, sampled boolean, words array<string>, counts binary, codes binary"
WORDS = [f"w{k}" for k in range(1, MOST_WORDS + 1)]


def _planes(codes: np.ndarray) -> bytes:
    """Numbers from -1 on as planes of equal bytes, which compress to much less."""
    return np.ascontiguousarray((codes + 1).astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _codes(planes: pa.BinaryScalar) -> np.ndarray:
    raw = np.frombuffer(planes.as_buffer(), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<i4").ravel() - np.int32(1)


def _hashes(values: pa.ListScalar) -> np.ndarray:
    return values.values.to_numpy(zero_copy_only=False).view(np.uint64)


def _chunk(lang: str, sampled: bool, data: bytes) -> pa.RecordBatch | None:
    """The row of a chunk; ``codes`` numbers its words, -1 ends a piece (as ``_planes``)."""
    raw = np.frombuffer(data.replace(_BREAK, b" " + _BREAK + b" "), np.uint8)
    inside = raw != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    length = edge[1::2] - edge[::2]
    if not len(length):
        return None
    spots = pa.Array.from_buffers(pa.large_binary(), len(length), [
        None, pa.py_buffer(np.concatenate(([0], np.cumsum(length))).astype(np.int64)), pa.py_buffer(raw[inside].tobytes())])
    coded = spots.dictionary_encode()
    words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int32)
    counts = np.bincount(codes, minlength=len(words))
    if _BREAK in words:                                           # it gets the code -1, the last word its place
        at = words.index(_BREAK)
        codes[codes == at] = -1
        codes[codes == len(words) - 1] = at if at < len(words) - 1 else -1
        counts[at], words[at] = counts[-1], words[-1]
        counts, words = counts[:-1], words[:-1]
    if not words:
        return None
    # frequent words first; -1 stays the last of the new numbers
    order = np.argsort(-counts, kind="stable")
    number = np.full(len(words) + 1, -1, np.int32)
    number[order] = np.arange(len(words), dtype=np.int32)
    row = [lang, sampled, [words[i].decode() for i in order], counts[order].astype(np.int64).tobytes(), _planes(number[codes])]
    kinds = [pa.string(), pa.bool_(), pa.list_(pa.string()), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["lang", "sampled", "words", "counts", "codes"])


def chunks(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Write the chunks of all documents to the shared folder and read them."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
                       F.col(text).cast("string").alias("text"))
    rows = rows.select("lang", (F.pmod(F.xxhash64(F.col("text"), F.monotonically_increasing_id()), F.lit(SAMPLE)) == 0).alias("sampled"),
                       F.encode("text", "UTF-8").alias("text")).where(F.octet_length("text") > 0)

    most = CHUNK

    def run(batches):
        held: dict[tuple, list[bytes]] = {}
        size: dict[tuple, int] = {}

        def flush(key):
            size.pop(key)
            made = _chunk(*key, _BREAK.join(held.pop(key)))
            return [made] if made is not None else []
        for b in batches:
            for name, sampled, t in zip(*b.columns):
                key, t = (name.as_py(), sampled.as_py()), t.as_py().translate(_FOLD)
                held.setdefault(key, []).append(t)
                size[key] = size.get(key, 0) + len(t)
                # all languages together hold two chunks at most
                while size and (max(size.values()) >= most or sum(size.values()) >= 2 * most):
                    yield from flush(max(size, key=size.get))
        for key in list(held):
            yield from flush(key)
    path = scratch_path(spark, "phrase_chunks")
    rows.mapInArrow(run, CHUNKS).write.options(compression="zstd", **LARGE_ROWS).parquet(path)
    # hashes take more room than their words: they are made again by each pass
    return spark.read.schema(CHUNKS).parquet(path).withColumn("hashes", F.transform("words", lambda w: F.xxhash64("lang", w)))


def word_totals(chunked: DataFrame) -> DataFrame:
    """lang and n, the number of its words."""
    def run(batches):
        for b in batches:
            n = [int(np.frombuffer(c.as_buffer(), np.int64).sum()) for c in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["lang", "n"])
    return chunked.select("lang", "counts").mapInArrow(run, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _join(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of the phrase ``key`` followed by ``word``."""
    h = (key ^ (key >> np.uint64(29))) * _MIX + word
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def _shift(bits: int) -> np.uint64:
    """How far a hash is shifted to be a place in a map of so many bits."""
    return np.uint64(65 - bits.bit_length())


def _has(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    slot = key >> _shift(64 * len(bits))
    return (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


class Proposals:
    """A bitmap of hashes of phrases, sent to the executors."""

    def __init__(self, spark: SparkSession, bits: np.ndarray | None = None):
        self.spark, self.bits = spark, np.zeros(FILTER_BITS // 64, np.uint64) if bits is None else bits
        self.sent = spark.sparkContext.broadcast(self.bits.tobytes())

    def plus(self, keys: DataFrame, key: str = "key", width: int = 64) -> Proposals:
        """With the hashes in a column added, of which the first ``width`` bits are given."""
        slot = F.shiftrightunsigned(F.col(key), int(_shift(64 * len(self.bits))) - 64 + width)
        bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
        # at most one row for each 64 bits of the map reaches the driver
        found = keys.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(bit).alias("bit")).toArrow()
        bits = self.bits.copy()
        bits[found.column("at").to_numpy()] |= found.column("bit").to_numpy().view(np.uint64)
        return Proposals(self.spark, bits)


def _phrases(hashes: np.ndarray, codes: np.ndarray, new: np.ndarray, old: np.ndarray | None):
    """(order, places, hashes) of the phrases of a chunk whose two parts are
    both in ``new`` but not both in ``old``: orders 2, 3 .. in turn."""
    at = np.flatnonzero(codes >= 0)                               # places where a phrase of the order before begins
    key = hashes[codes[at]]
    in_new = _has(new, hashes)[codes[at]]
    in_old = _has(old, hashes)[codes[at]] if old is not None else np.zeros(len(at), bool)
    for order in range(2, MOST_WORDS + 1):
        # a phrase begins where two of the order before, both proposed, begin at neighbouring places
        pair = np.flatnonzero((at[1:] == at[:-1] + 1) & in_new[1:] & in_new[:-1])
        counted = in_old[pair] & in_old[pair + 1]
        at = at[pair]
        key = _join(key[pair], hashes[codes[at + (order - 1)]])
        yield order, at[~counted], key[~counted]
        if order < MOST_WORDS:
            in_new = _has(new, key)
            # a bit that others set in ``old`` tells nothing of a phrase that the pass with it did not reach
            in_old = counted & _has(old, key) if old is not None else counted


def _width(tokens: int) -> int:
    """Bits of a hash by which the passes look for what may be frequent: so many
    that few phrases share one; what does is told apart by the whole hash later."""
    return max(FILTER_BITS.bit_length() - 1, min(64, 4 + tokens.bit_length()))


def _packed(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending keys as differences, and their counts, both in planes of equal bytes."""
    planes = [np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8), n.astype("<u4").view(np.uint8).reshape(-1, 4)]
    return zstandard.ZstdCompressor(1).compress(b"".join(np.ascontiguousarray(p.T).tobytes() for p in planes))


def _unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8)
    m = len(raw) // 12
    step = np.ascontiguousarray(raw[:8 * m].reshape(8, m).T).view("<u8").ravel()
    n = np.ascontiguousarray(raw[8 * m:].reshape(4, m).T).view("<u4").ravel()
    return np.cumsum(step, dtype=np.uint64), n.astype(np.int64)


def _summed(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    keys, n = np.concatenate(keys), np.concatenate(n)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n[order], first) if len(first) else n


def _added(chunked: DataFrame, columns: list[str], keys_of, parts: int, tokens: int, width: int, least: int) -> DataFrame:
    """order, key and n of the keys with at least so many places.  ``keys_of``
    gives (order, keys, counts or None) for the values of the columns of a
    chunk; a key is the first ``width`` bits of a hash, ``parts`` how many a
    word has at most."""
    ranges = (parts * tokens // BLOCK_KEYS).bit_length()            # as a power of two
    edges = np.arange(1 << ranges, dtype=np.uint64) << np.uint64(width - ranges)
    block_keys, cut_off = BLOCK_KEYS, np.uint64(64 - width)

    def run(batches):
        held: dict[int, tuple[list, list]] = {}
        size = 0

        def blocks():
            for order, parts in held.items():
                keys, n = _summed(*parts)
                cut = np.append(np.searchsorted(keys, edges), len(keys))
                at = np.flatnonzero(np.diff(cut))
                rows = [_packed(keys[cut[k]:cut[k + 1]], n[cut[k]:cut[k + 1]]) for k in at]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), order, np.int8)), pa.array(at.astype(np.int32)),
                                                  pa.array(rows, pa.binary())], names=["order", "range", "block"])
            held.clear()
        for b in batches:
            for values in zip(*b.columns):
                for order, key, n in keys_of(*values):
                    key = key >> cut_off
                    if n is None:
                        key, n = np.unique(key, return_counts=True)
                    parts = held.setdefault(order, ([], []))
                    parts[0].append(key)
                    parts[1].append(n)
                    size += len(key)
                if size >= block_keys:
                    yield from blocks()
                    size = 0
        yield from blocks()

    def add_up(table: pa.Table) -> pa.Table:
        keys, n = _summed(*zip(*[_unpacked(b.as_py()) for b in table.column("block")]))
        often = n >= least
        return pa.table([pa.array(np.full(often.sum(), table.column("order")[0].as_py(), np.int8)), pa.array(keys[often].view(np.int64)),
                         pa.array(n[often])], names=["order", "key", "n"])
    packed = chunked.select(*columns).mapInArrow(run, "order tinyint, range int, block binary")
    return packed.groupBy("order", "range").applyInArrow(add_up, "order tinyint, key bigint, n bigint")


def likely(chunked: DataFrame, tokens: int, new: Proposals, old: Proposals | None = None, orders: tuple[int, ...] = (2, 3, 4),
           least: int = 1) -> DataFrame:
    """order and key (the first ``_width(tokens)`` bits of the hash) of the
    phrases whose two parts are both in ``new`` but not both in ``old`` and
    whose key has at least so many places."""
    new_sent, old_sent = new.sent, old.sent if old is not None else None

    def keys_of(hashes, codes):
        new_bits = np.frombuffer(new_sent.value, np.uint64)
        old_bits = np.frombuffer(old_sent.value, np.uint64) if old_sent is not None else None
        for order, _, key in _phrases(_hashes(hashes), _codes(codes), new_bits, old_bits):
            if order in orders:
                yield order, key, None
            if order == max(orders):
                break
    return _added(chunked, ["hashes", "codes"], keys_of, len(orders), tokens, _width(tokens), least).select("order", "key")


def _named(exact: DataFrame, on: list[str], chunked: DataFrame, found) -> DataFrame:
    """``exact`` with what its hashes stand for, which ``found`` gives for those
    of some chunks: nearly all are met in the sample, and only the others are
    looked for in the rest."""
    met = exact.join(found(chunked.where("sampled"), exact), on).checkpoint()
    lacking = exact.join(met, on, "left_anti").checkpoint()
    return met.unionByName(lacking.join(found(chunked.where("not sampled"), lacking), on))


def word_counts(chunked: DataFrame, tokens: int, least: int) -> DataFrame:
    """lang, word, w (hash) and n of every word with at least so many places."""
    spark = chunked.sparkSession

    def keys_of(hashes, counts):
        return [(1, _hashes(hashes), np.frombuffer(counts.as_buffer(), np.int64))]
    exact = _added(chunked, ["hashes", "counts"], keys_of, 1, tokens, 64, least).select(F.col("key").alias("w"), "n").checkpoint()

    def found(some, hot):
        hot_sent = Proposals(spark).plus(hot, "w").sent

        def run(batches):
            bits = np.frombuffer(hot_sent.value, np.uint64)
            for b in batches:
                for lang, words, hashes in zip(*b.columns):
                    mine = words.values.filter(pa.array(_has(bits, _hashes(hashes))))
                    yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(mine), pa.string()), mine], names=["lang", "word"])
        rows = some.select("lang", "words", "hashes").mapInArrow(run, "lang string, word string").distinct()
        return rows.withColumn("w", F.xxhash64("lang", "word"))
    return _named(exact, ["w"], chunked, found).select("lang", "word", "w", "n")


def _hashed(rows: DataFrame) -> DataFrame:
    """Phrases (lang, w1 .. w4) with their order and key, the whole hash."""
    def run(batches):
        for b in batches:
            key, order = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64), np.ones(b.num_rows, np.int8)
            for c in b.columns[2:]:
                there = c.is_valid().to_numpy(zero_copy_only=False)
                key = np.where(there, _join(key, c.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)), key)
                order += there
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(order), pa.array(key.view(np.int64))],
                                             names=["lang", *WORDS, "order", "key"])
    return rows.mapInArrow(run, "lang string, " + ", ".join(f"{w} bigint" for w in WORDS) + ", order tinyint, key bigint")


def counts(chunked: DataFrame, tokens: int, reach: Proposals, hot: Proposals, least: int) -> DataFrame:
    """lang, w1 .. w4 (null after the last word) and n of the phrases whose two
    parts are in ``reach``, which are in ``hot`` themselves and have at least so
    many places."""
    spark, reach_sent, hot_sent = chunked.sparkSession, reach.sent, hot.sent

    def keys_of(hashes, codes):
        reach_bits, hot_bits = np.frombuffer(reach_sent.value, np.uint64), np.frombuffer(hot_sent.value, np.uint64)
        for order, _, key in _phrases(_hashes(hashes), _codes(codes), reach_bits, None):
            yield order, key[_has(hot_bits, key)], None
    exact = _added(chunked, ["hashes", "codes"], keys_of, 3, tokens, 64, least).checkpoint()

    def found(some, kept):
        kept_sent = Proposals(spark).plus(kept).sent

        def run(batches):
            reach_bits, kept_bits = np.frombuffer(reach_sent.value, np.uint64), np.frombuffer(kept_sent.value, np.uint64)
            for b in batches:
                for lang, hashes, codes in zip(*b.columns):
                    hashes, codes = _hashes(hashes), _codes(codes)
                    for order, at, key in _phrases(hashes, codes, reach_bits, None):
                        mine = _has(kept_bits, key)
                        at = at[mine][np.unique(key[mine], return_index=True)[1]]
                        cols = [pa.array([lang.as_py()] * len(at), pa.string())]
                        cols += [pa.array(hashes[codes[at + k]].view(np.int64)) for k in range(order)]
                        cols += [pa.nulls(len(at), pa.int64())] * (MOST_WORDS - order)
                        whole = pa.RecordBatch.from_arrays(cols, names=["lang", *WORDS])
                        for i in range(0, len(at), OUT_ROWS):
                            yield whole.slice(i, OUT_ROWS)
        kinds = "lang string, " + ", ".join(f"{w} bigint" for w in WORDS)
        return _hashed(some.select("lang", "hashes", "codes").mapInArrow(run, kinds).distinct())
    return _named(exact, ["order", "key"], chunked, found).select("lang", *WORDS, "n")


def propose(chunked: DataFrame, tokens: int, words: Proposals, least: int) -> Proposals:
    """The frequent words and the phrases of two and three words that are
    frequent in the sample; those of four make no longer ones possible."""
    sample, low = chunked.where("sampled"), max(1, int(least / SAMPLE * LOWERED))
    for order in range(2, MOST_WORDS):
        words = words.plus(likely(sample, tokens, words, orders=(order,), least=low), width=_width(tokens))
    return words


def frequent(chunked: DataFrame, least: int = 30) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(totals, words, phrases): the words of each language (lang, n), those
    with at least ``least`` places (lang, word, w, n), and all phrases of one to
    four words with as many (lang, w1 .. w4, n)."""
    spark = chunked.sparkSession
    ensure_checkpoint_dir(spark)
    totals = word_totals(chunked).checkpoint()
    tokens = totals.agg(F.sum("n")).first()[0] or 0
    often = word_counts(chunked, tokens, least).checkpoint()
    width = _width(tokens)
    before, reach, hot = None, propose(chunked, tokens, Proposals(spark).plus(often, "w"), least), Proposals(spark)
    while True:
        found = likely(chunked, tokens, reach, before, least=least).checkpoint()
        hot = hot.plus(found, width=width)
        # border failures, frequent but not proposed, add to what a pass reaches
        before, reach = reach, reach.plus(found.where(F.col("order") < MOST_WORDS), width=width)
        if np.array_equal(before.bits, reach.bits):
            break
    phrases = counts(chunked, tokens, reach, hot, least)
    singles = often.select("lang", F.col("w").alias("w1"), *[F.lit(None).cast("long").alias(w) for w in WORDS[1:]], "n")
    return totals, often, singles.unionByName(phrases)


def score(a: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(2000000 * a / (l + r)) of long columns, exactly."""
    wide = [f"cast({c} as decimal(20,0))" for c in (a, l, r)]
    return F.expr(f"(cast(2000000 as decimal(10,0)) * {wide[0]}) div ({wide[1]} + {wide[2]})")


def mine(docs: DataFrame, least: int = 30, share: int = 80, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first ``top``
    phrases; ``share`` per cent of a phrase's places inside a longer one drop it."""
    totals, words, found = frequent(chunks(docs, text, lang), least)
    # a frequent phrase is named by one hash from here on: nulls after its last word don't change it
    found = found.withColumn("id", F.xxhash64(*WORDS)).checkpoint()
    all_words = F.array_compact(F.array(*WORDS))
    phrases = found.where("w2 is not null").select("lang", "id", F.col("n").alias("a"), all_words.alias("w")).withColumn("size", F.size("w"))

    def part(first, n):
        """The name of ``n`` words from the place ``first`` on."""
        return F.xxhash64(*[F.when(F.lit(k) < n, F.get("w", first + k)) for k in range(MOST_WORDS)])

    cuts = phrases.select("id", "a", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(
        part(F.lit(0), k).alias("left"), part(k, F.col("size") - k).alias("right")))).alias("k", "cut"))
    cuts = cuts.select("id", "a", "k", "cut.left", "cut.right")
    for side, out in (("left", "l"), ("right", "r")):
        cuts = cuts.join(found.select(F.col("id").alias(side), F.col("n").alias(out)), side).drop(side)
    scored = cuts.withColumn("score", score("a", "l", "r")).groupBy("id").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(
        F.sequence(F.lit(0), F.col("size") - n), lambda at: part(at, n))))
    longer = phrases.where("size > 2").select("a", F.explode(F.array_distinct(inner)).alias("id")).groupBy("id").agg(F.max("a").alias("outer"))
    kept = phrases.select("lang", "id", "a").join(scored, "id").join(longer, "id", "left").where(
        F.col("outer").isNull() | (F.lit(100).cast("decimal(20,0)") * F.col("outer") < F.lit(share).cast("decimal(20,0)") * F.col("a")))
    kept = kept.select("lang", "id", "a", "cut.l", "cut.r", "cut.score")

    # words are looked up for the phrases that may be among the first, ties included
    best = F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))
    kept = kept.withColumn("at", best).where(F.col("at") <= top).drop("at")
    kept = kept.join(found.select("id", *WORDS), "id").drop("id")
    spelled = words.select("word", "w")
    for k, w in enumerate(WORDS):
        kept = kept.join(spelled.select(F.col("w").alias(w), F.col("word").alias(f"s{k}")), w, "inner" if k < 2 else "left")
    kept = kept.select("lang", F.concat_ws(" ", *[f"s{k}" for k in range(MOST_WORDS)]).alias("phrase"), "a", "l", "r", "score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    first = kept.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
