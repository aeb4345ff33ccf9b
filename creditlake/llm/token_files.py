"""Token files compressed by Re-Pair grammars.

Documents are put in ascending doc_id order, encoded, and written as shards.
A shard replaces frequent pairs of neighbouring ids by new symbols, again and
again, until no pair is frequent; it stores the rules, how many ids each rule expands to, and the rest
sequence, so any document of a shard is decoded from the symbols that cover it.

File format (Parquet, one row per shard; all numbers little endian):
``part``, ``shard`` (order of the shards: range of doc_ids, then number in it),
``n_docs``, ``n_ids``, ``doc_ids`` (int64 and one validity byte each),
``lengths`` (int64, ids per document with its end id), ``rules`` (pairs of
uint32; rule k makes the symbol ``first + k``), ``expansions`` (uint32, ids per
rule), ``symbols`` (uint32), ``first`` (the first symbol that is no id).

Defined cases: a null or empty text has the end id only; a very long text is
encoded whole and ends its shard; documents without a
doc_id come first; repeated rows are written one after the other; no documents
give no shards; other columns, of any name, are not written.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from creditlake.session import scratch_path

from .columns import shuffle_partitions
from .units import Memo, Units, slices

#: pre-tokens given to the library's model at once
JOINED = 512
#: ids of a shard: it ends with the document that reaches this many
SHARD_IDS = 1 << 21
#: rules made at once; rounds go on until no pair occurs ``MIN_COUNT`` times
RULES_PER_ROUND = 16384
#: a pair must occur this often in the shard to become a rule: from here on the
#: rule's 12 bytes take less room than the 4 bytes that each place saves
MIN_COUNT = 4
FORMAT = ("part int, shard int, n_docs int, n_ids long, doc_ids binary, lengths binary, "
          "rules binary, expansions binary, symbols binary, first long")


def _byte_letters() -> str:
    """The letter that stands for each byte in the vocabulary: printable Latin-1
    characters for themselves, the other bytes, in order, from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return "".join(chr(b if b in shown else next(others)) for b in range(256))


def _word_starts(raw: np.ndarray) -> np.ndarray:
    """Where a single space stands between two characters that are none: no
    pre-token goes on over the beginning of such a word."""
    gap = (raw == 32) | (raw == 10)
    return (raw[1:-1] == 32) & ~gap[:-2] & ~gap[2:]


class ByteBpe:
    """The tokenizers library behind a memory of words.

    Its pre-tokens are encoded independently of each other, so each distinct
    one is encoded once, by the library's model, and each distinct word of a
    slice of texts is put together of pre-tokens once.  Texts with other white
    space than spaces and line ends are a word of their own."""

    ODD_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer
        from public_tokenizers import PATTERN
        self.lib = Tokenizer.from_file(path)
        if self.lib.normalizer is not None:
            raise ValueError("a tokenizer with a normalizer can't be fed word by word")
        self.tokenize = self.lib.model.tokenize
        self.cut = regex.compile(PATTERN)
        self.letters = dict(enumerate(_byte_letters()))
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.odd = [o.encode() for o in self.added]
        # byte 0xFF is in no text; if no token has its letter beside others, it parts words for good
        self.mark = self.letters[0xFF]
        vocabulary = self.lib.get_vocab(with_added_tokens=False)
        self.mark_id = vocabulary.get(self.mark) if sum(self.mark in t for t in vocabulary) == 1 else None
        self._token = Memo(self._encode_tokens)
        self._word = Memo(self._encode_words)

    def _spelled(self, token: str) -> str:
        # printable ASCII letters stand for themselves
        if token.isascii() and token.isprintable():
            return token.replace(" ", self.letters[32])
        return token.encode().decode("latin-1").translate(self.letters)

    def _encode_tokens(self, tokens: list[str]) -> list[bytes]:
        """Ids of pre-tokens by the library's model, many in one call."""
        spelled = list(map(self._spelled, tokens))
        if self.mark_id is None:
            return [array("I", [t.id for t in self.tokenize(s)]).tobytes() for s in spelled]
        out = []
        for k in range(0, len(spelled), JOINED):
            ids = array("I", [t.id for t in self.tokenize(self.mark.join(spelled[k:k + JOINED]))])
            flat = np.frombuffer(ids, np.uint32)
            at = np.concatenate(([-1], np.flatnonzero(flat == self.mark_id), [len(flat)])).tolist()
            raw = ids.tobytes()
            out += [raw[4 * i + 4:4 * j] for i, j in zip(at, at[1:])]
        return out

    def _cut(self, texts: list[str]) -> list[bytes]:
        """Ids of texts by way of their distinct pre-tokens."""
        # a space and letters are one pre-token
        cut = {k: self.cut.findall(t) for k, t in enumerate(texts) if not (t[:1] == " " and t[1:].isalpha())}
        ids = dict.fromkeys(chain((t for k, t in enumerate(texts) if k not in cut), *cut.values()))
        ids = dict(zip(ids, self._token.all(list(ids))))
        return [b"".join(map(ids.__getitem__, cut[k])) if k in cut else ids[t] for k, t in enumerate(texts)]

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        return self._cut([w.decode() for w in words])

    def encode_all(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids as unsigned 32-bit integers, where each text's begin and the end)."""
        whole = b"\n".join(texts)
        odd = any(a in whole for a in self.odd) or self.ODD_SPACE.search(whole.decode())
        if odd:
            plain = [not (any(a in t for a in self.odd) or self.ODD_SPACE.search(t.decode())) for t in texts]
            flats, sizes = [], np.zeros(len(texts), np.int64)
            for k, (t, ok) in enumerate(zip(texts, plain)):
                flat = self.encode_all([t])[0] if ok else np.frombuffer(self._encode_odd(t), np.uint32)
                flats.append(flat)
                sizes[k] = len(flat)
            return np.concatenate(flats), np.concatenate(([0], np.cumsum(sizes)))
        found = Units(texts, _word_starts)
        return found.joined(self._word.all(found.distinct), np.uint32)

    def _encode_odd(self, text: bytes) -> bytes:
        t = text.decode()
        if any(a in t for a in self.added):
            return array("I", self.lib.encode(t, add_special_tokens=False).ids).tobytes()
        return self._cut([t])[0]

    def encode(self, text: str | None) -> bytes:
        """The library's ids of a text."""
        return self.encode_all([(text or "").encode()])[0].tobytes()


@lru_cache(maxsize=2)
def coder(path: str) -> ByteBpe:
    return ByteBpe(path)


def _taken(at: np.ndarray, rule: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of the places ``at`` are replaced, so that none overlaps another:
    of neighbouring places the one whose rule ranks higher, of equal rules every
    second one."""
    free, taken = np.arange(len(at)), []
    while len(free):
        joined, more = np.diff(at[free]) == 1, np.sign(np.diff(rank[rule[free]]))
        run = np.maximum.accumulate(np.where(np.concatenate(([True], ~joined | (more != 0))), np.arange(len(free)), 0))
        take = (np.arange(len(free)) - run) % 2 == 0
        take[:-1] &= ~(joined & (more > 0))
        take[1:] &= ~(joined & (more < 0))
        taken.append(free[take])
        over = take.copy()                                          # places that a replaced one overlaps
        over[:-1] |= joined & take[1:]
        over[1:] |= joined & take[:-1]
        free = free[~over]
    return np.sort(np.concatenate(taken))


def _pairs_at(seq: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, number of the pair at each, pairs, counts) of those places
    ``at`` whose pair occurs ``least`` times among them; pairs are in order."""
    code = seq[at].astype(np.uint64) << np.uint64(32) | seq[at + 1]
    bits = max(4, (2 * len(at)).bit_length())
    slot = (code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).view(np.int64)
    # counts of slots throw out most places
    often = np.flatnonzero((np.bincount(slot) >= least)[slot])
    at, code, slot = at[often], code[often], slot[often]
    # a slot stands for one of the pairs in it; places of others are sorted
    own = np.zeros(1 << bits, np.uint64)
    own[slot] = code
    odd = own[slot] != code
    count = np.bincount(slot[~odd], minlength=1 << bits)
    full = np.flatnonzero(count)
    strange, strange_at, strange_count = np.unique(code[odd], return_inverse=True, return_counts=True)
    pairs = np.concatenate([own[full], strange])
    count = np.concatenate([count[full], strange_count])
    which = np.empty(len(at), np.int64)
    place = np.zeros(1 << bits, np.int32)
    place[full] = np.arange(len(full))
    which[~odd] = place[slot[~odd]]
    which[odd] = len(full) + strange_at
    # number the frequent ones in the order of the pairs
    keep = np.flatnonzero(count >= least)
    keep = keep[np.argsort(pairs[keep])]
    number = np.full(len(pairs), -1, np.int64)
    number[keep] = np.arange(len(keep))
    which = number[which]
    mine = which >= 0
    return at[mine], which[mine], pairs[keep], count[keep]


def compress(ids: np.ndarray, rounds: int | None = None, per_round: int = RULES_PER_ROUND,
             least: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(symbols, rules, expansions, first) of a sequence of ids, with rules
    until no pair is frequent or for so many ``rounds``.

    A pair of symbols that were there before only loses places, so what is
    infrequent stays so: after the first round only the places beside a
    replaced pair, and frequent pairs that were not replaced, are counted."""
    seq = np.array(ids, np.uint32)
    first = int(seq.max()) + 1 if len(seq) else 0
    rules, size = [np.zeros((0, 2), np.uint32)], [np.ones(1, np.uint32)]   # the first size is that of ids
    known, made_in = first, 0
    at = np.arange(len(seq) - 1)
    while len(at) and made_in != rounds:
        made_in += 1
        at, which, pairs, count = _pairs_at(seq, at, least)
        if not len(pairs):
            break
        # the most frequent pairs; by count, then pair: a full order, so a shard written again is the same
        chosen = np.zeros(len(pairs), bool)
        chosen[np.lexsort((pairs, -count))[:per_round] if len(pairs) > per_round else slice(None)] = True
        mine = chosen[which]
        # of overlapping places the pair that occurs (twice) more often is replaced, else one
        # by a hash, so that copies of a passage are cut alike
        order = np.arange(len(pairs), dtype=np.uint64) * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)
        order |= np.frexp(count)[1].astype(np.uint64) << np.uint64(32)
        rank = np.argsort(np.argsort(order)).astype(np.int32)
        took = _taken(at[mine], which[mine], rank)
        spots, rule = at[mine][took], which[mine][took]
        used = np.zeros(len(pairs), bool)
        used[rule] = True
        number = (known - 1 + np.cumsum(used)).astype(np.uint32)
        made = np.stack([pairs[used] >> np.uint64(32), pairs[used] & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)
        gone = np.zeros(len(seq) + 1, bool)                          # symbols that are in a replaced pair
        gone[spots] = gone[spots + 1] = True
        left = at[~gone[at] & ~gone[at + 1]]                         # frequent pairs that are as they were
        stays = np.ones(len(seq), bool)
        stays[spots + 1] = False
        seq[spots] = number[rule]
        place = np.cumsum(stays) - 1
        seq = seq[stays]
        new = place[spots]
        at = np.concatenate([place[left], new - 1, new])
        flag = np.zeros(len(seq), bool)
        flag[at[at >= 0]] = True
        at = np.flatnonzero(flag[:-1])
        widths = np.concatenate(size)
        lengths = widths[np.where(made < first, 0, made.astype(np.int64) - first + 1)].sum(axis=1)
        rules.append(made)
        size.append(lengths.astype(np.uint32))
        known += len(made)
    return seq, np.concatenate(rules), np.concatenate(size)[1:], first


def _expansions(rules: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat, begin, width): what symbol k stands for is flat[begin[k]:][:width[k]].
    Rules only use earlier symbols, so whole ranges of them are made at once."""
    flat = [np.arange(first, dtype=np.uint32)]
    begin, width = np.arange(first + len(rules), dtype=np.int64), np.ones(first + len(rules), np.int64)
    done, end = first, first
    while done < first + len(rules):
        sides = rules[done - first:].astype(np.int64)
        # rules up to the next one that uses a symbol of this range
        ready = int(np.argmax(np.append((sides >= done).any(axis=1), True)))
        sides = sides[:ready]
        got = _gather(np.concatenate(flat), begin, width, sides.ravel())
        width[done:done + ready] = width[sides].sum(axis=1)
        begin[done:done + ready] = end + np.cumsum(width[done:done + ready]) - width[done:done + ready]
        flat.append(got)
        done, end = done + ready, end + len(got)
    return np.concatenate(flat), begin, width


def _gather(flat: np.ndarray, begin: np.ndarray, width: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    n = width[symbols]
    end = np.cumsum(n)
    return flat[np.repeat(begin[symbols] - (end - n), n) + np.arange(end[-1] if len(end) else 0)]


def expand(symbols: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """Ids of a sequence of symbols."""
    return _gather(*_expansions(rules, first), symbols.astype(np.int64))


def slice_ids(symbols: np.ndarray, rules: np.ndarray, expansions: np.ndarray, first: int, begin: int, end: int) -> np.ndarray:
    """Ids begin:end of a shard, expanding only the symbols that cover them."""
    is_rule = symbols >= first
    width = np.ones(len(symbols), np.int64)
    width[is_rule] = expansions[symbols[is_rule] - first]
    stop = np.cumsum(width)
    lo = int(np.searchsorted(stop, begin, "right"))
    hi = int(np.searchsorted(stop, end, "left")) + 1
    part = expand(symbols[lo:hi], rules, first)
    skip = begin - (int(stop[lo - 1]) if lo else 0)
    return part[skip:skip + end - begin]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, text: str = "text",
          parts: int | None = None, shard_ids: int = SHARD_IDS) -> None:
    """Encode ``docs`` in ascending doc_id order and write the shards to the
    shared folder ``path``.  Texts are shuffled once, by ranges of doc_id."""
    parts = parts or shuffle_partitions(docs.sparkSession)
    dealt = (docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text"))
             .repartitionByRange(parts, F.col("doc_id").asc_nulls_first())
             .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text"))

    def run(batches):
        lib, part, shard = coder(tokenizer), TaskContext.get().partitionId(), 0
        names, lengths, ids, held = [], [], [], 0

        def row():
            return _shard_row(part, shard, names, np.array(lengths, np.int64), np.concatenate(ids))
        for b in batches:
            doc_ids = b.column(0).to_pylist()
            for at, texts in slices(b.column(1)):
                flat, begin = lib.encode_all(texts)
                flat = np.insert(flat, begin[1:], np.uint32(end_id))
                begin = begin + np.arange(len(begin))
                done = 0
                while done < len(texts):
                    # a shard ends with the document that reaches its size
                    stop = min(len(texts), int(np.searchsorted(begin, begin[done] + shard_ids - held)))
                    names += doc_ids[at + done:at + stop]
                    lengths += np.diff(begin[done:stop + 1]).tolist()
                    ids.append(flat[begin[done]:begin[stop]])
                    held += int(begin[stop] - begin[done])
                    done = stop
                    if held >= shard_ids:
                        yield row()
                        shard, names, lengths, ids, held = shard + 1, [], [], [], 0
        if names:
            yield row()
    dealt.mapInArrow(run, FORMAT).write.parquet(path)


def _shard_row(part: int, shard: int, names: list, lengths: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    symbols, rules, size, first = compress(ids)
    known = np.array([n is not None for n in names], np.uint8)
    number = np.array([n or 0 for n in names], "<i8")
    row = {"part": part, "shard": shard, "n_docs": len(names), "n_ids": len(ids),
           "doc_ids": number.tobytes() + known.tobytes(), "lengths": lengths.astype("<i8").tobytes(),
           "rules": rules.astype("<u4").tobytes(), "expansions": size.astype("<u4").tobytes(),
           "symbols": symbols.astype("<u4").tobytes(), "first": first}
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64()] + [pa.binary()] * 5 + [pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], names=list(row))


def read(spark: SparkSession, path: str) -> DataFrame:
    """part, shard, place (of the document in the shard), doc_id, first_id (in
    the shard) and ids of every document, decoded from the files."""
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                yield from _documents(r)
    return spark.read.schema(FORMAT).parquet(path).mapInArrow(
        run, "part int, shard int, place int, doc_id long, first_id long, ids array<int>")


def _shard(r: dict) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(ids, end of each document, doc_ids) of a shard."""
    n = r["n_docs"]
    number, known = np.frombuffer(r["doc_ids"], "<i8", n), np.frombuffer(r["doc_ids"], np.uint8, n, 8 * n)
    rules = np.frombuffer(r["rules"], "<u4").reshape(-1, 2)
    ids = expand(np.frombuffer(r["symbols"], "<u4"), rules, r["first"])
    return ids, np.cumsum(np.frombuffer(r["lengths"], "<i8")), pa.array(number, pa.int64(), mask=known == 0)


def _documents(r: dict, rows: int = 512):
    ids, end, names = _shard(r)
    begin = np.concatenate(([0], end[:-1]))
    for i in range(0, len(end), rows):
        j = min(i + rows, len(end))
        offsets = np.append(begin[i:j], end[j - 1]) - begin[i]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(j - i, r["part"]), pa.int32()), pa.array(np.full(j - i, r["shard"]), pa.int32()),
            pa.array(np.arange(i, j), pa.int32()), names[i:j], pa.array(begin[i:j], pa.int64()),
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids[begin[i]:end[j - 1]].astype(np.int32)))],
            names=["part", "shard", "place", "doc_id", "first_id", "ids"])


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, shard, base): ids of all shards before each, from the file
    headers; summed within parts and over the parts (one row each)."""
    head = spark.read.schema(FORMAT).parquet(path).select("part", "shard", "n_ids")
    own = Window.partitionBy("part").orderBy("shard")
    inside = head.withColumn("inside", F.sum("n_ids").over(own) - F.col("n_ids"))
    part = head.groupBy("part").agg(F.sum("n_ids").alias("n"))
    part = part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return inside.join(part, "part").select("part", "shard", (F.col("before") + F.col("inside")).alias("base"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as little-endian
    unsigned 32-bit integers, of every document in the files."""
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                ids, end, names = _shard(r)
                ids, begin = ids.astype("<u4"), np.concatenate(([0], end[:-1]))
                crc = [zlib.crc32(ids[i:j]) for i, j in zip(begin, end)]
                n = len(end)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, r["part"]), pa.int32()), pa.array(np.full(n, r["shard"]), pa.int32()), names,
                     pa.array(begin, pa.int64()), pa.array(end - begin, pa.int64()), pa.array(crc, pa.int64())],
                    names=["part", "shard", "doc_id", "first_id", "n_tokens", "ids_crc32"])
    found = spark.read.schema(FORMAT).parquet(path).mapInArrow(
        run, "part int, shard int, doc_id long, first_id long, n_tokens long, ids_crc32 long")
    return found.join(starts(spark, path), ["part", "shard"]).select(
        "doc_id", (F.col("base") + F.col("first_id")).alias("start"), "n_tokens", "ids_crc32")


def write_and_check(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write token files into a fresh folder below the session's shared
    checkpoint folder and return what is read back from them."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token_files")
    write(docs, path, tokenizer, end_id)
    return checksums(spark, path)
