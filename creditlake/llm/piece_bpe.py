"""SentencePiece BPE encoding by backtracking, and decoding.

The result of merging (always the adjacent pair whose union is the best piece,
leftmost first) is the only sequence of pieces in which every two neighbours
are compatible, that is, merging their joined text gives just these two again.
So a text is encoded without a merge queue: an Aho-Corasick automaton gives the
longest piece at every place; pieces are taken from left to right, longest
first, if they are compatible with the piece before; where nothing fits, the
place is marked in a bitfield as failed and the last piece is taken back.

Two pieces are merged again from their ends: the merges that made them are
undone, latest first, and at no time may the parts at the seam be a piece that
merges earlier than what was undone.  That is the definition's result without
its queue where every piece merges later than its parts; others are merged.

The model's pieces bound what can merge: no piece has a space mark after
another character, and characters that are in no piece (written as bytes)
never merge.  So a word with the spaces before it is encoded on its own: each
distinct one of a slice of texts once, and those of late are remembered per
worker, within a bound of bytes.

Defined cases: a null text is the empty text and has no ids; an empty table has
no rows; very long texts are a slice of their own, encoded whole; a literal U+2581
is a space mark and decodes as a space, as in the library; repeated rows give
repeated rows; other columns are left out (``keep`` keeps them, of any name but
``ids`` and ``decoded``).
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache
from itertools import chain
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .units import Memo, Units, slices

MARK = "▁"
#: documents per Arrow batch that ``decode`` returns
OUT_ROWS = 256
#: pairs of pieces that are remembered
PAIRS = 1 << 18


class PieceBpe:
    """Vocabulary of a BPE model file and the coder over it."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes_id = [0] * 256
        self.id_bytes: list[bytes | None] = [b""] * n     # what an id decodes to, None for byte pieces
        self.byte_of: dict[int, int] = {}
        self.rank: dict[str, float] = {}                  # piece -> order of merging, small first
        self.id_of: dict[str, int] = {}
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_of[i] = int(p[3:5], 16)
                self.bytes_id[self.byte_of[i]] = i
                self.id_bytes[i] = bytes([self.byte_of[i]])
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.rank[p], self.id_of[p] = -sp.get_score(i), i
                self.id_bytes[i] = p.replace(MARK, " ").encode()
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.rank):
            raise ValueError("a piece has a space mark inside; words can't be encoded on their own")
        self.id_width = np.array([len(b) for b in self.id_bytes], np.int64)
        self.trie = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            self.trie.add_word(p, (i, len(p)))
        self.trie.make_automaton()
        self.pieces = {i: p for p, i in self.id_of.items()}
        self.order = [self.rank.get(self.pieces.get(i), 0.0) for i in range(n)]
        self.size = [len(self.pieces.get(i, "")) for i in range(n)]
        # the longest shorter piece that a piece begins with, -1 if there is none
        self.shorter = [-1] * n
        self.joined: dict[int, int] = {}                          # two ids -> the piece they are together
        for p, i in self.id_of.items():
            for k in range(1, len(p)):
                a, b = self.id_of.get(p[:k]), self.id_of.get(p[k:])
                if a is not None:
                    self.shorter[i] = a
                    if b is not None:
                        self.joined[a * n + b] = i
        self.n = n
        self._pairs: dict[int, bool] = {}
        self._made: dict[int, tuple[int, int, bool] | None] = {}  # one entry a piece at most
        self._part = Memo(self._encode_parts, 8 << 20)
        self._unit = Memo(self._encode_units)
        # two neighbouring characters that are in no piece together never meet in a merge
        self._bridges = {p[i:i + 2] for p in self.rank for i in range(len(p) - 1)}

    # merging, the definition
    def merge(self, text: str) -> list[str]:
        parts = list(text)
        while True:
            best = min(((self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank),
                       default=None)
            if best is None:
                return parts
            i = best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    def made(self, piece: int) -> tuple[int, int, bool] | None:
        """The two pieces whose merge makes a piece of several characters, and
        whether this merge and all before it come in the order of the pieces'
        ranks; None if merging doesn't make the piece."""
        if piece not in self._made:
            parts, last, in_turn, before = list(self.pieces[piece]), None, True, -float("inf")
            while len(parts) > 1:
                best = min(((self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank),
                           default=None)
                if best is None:
                    last = None
                    break
                rank, i = best
                last = parts[i], parts[i + 1]
                in_turn, before = in_turn and rank >= before, rank
                parts[i:i + 2] = ["".join(last)]
            known = last and [self.id_of.get(x) for x in last]
            # a character that is no piece itself can't be told by an id
            self._made[piece] = (*known, in_turn) if known and None not in known else (-1, -1, False) if last else None
        return self._made[piece]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging two pieces (a = -1: one) leaves them as they are."""
        known = self._pairs.get(a * self.n + b)
        if known is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            known = self._pairs[a * self.n + b] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        size, made, order, n = self.size, self.made, self.order, self.n
        if a < 0:
            return size[b] == 1 or made(b) is not None
        first, second, limit = a, b, float("inf")
        left, right = size[a] > 1 and made(a), size[b] > 1 and made(b)
        while left is not None and right is not None and (not left or left[2]) and (not right or right[2]):
            whole = self.joined.get(a * n + b)
            if whole is not None and order[whole] < limit:
                return False
            if left and (not right or order[a] > order[b]):
                limit, a = order[a], left[1]
                left = size[a] > 1 and made(a)
            elif right:
                # of equal pairs the left one merges first, so the seam does before b
                limit, b = order[b] + 0.5, right[0]
                right = size[b] > 1 and made(b)
            else:
                return True
        pieces = self.pieces[first], self.pieces[second]
        return self.merge("".join(pieces)) == [*pieces]

    def segment(self, text: str) -> list[int]:
        """Pieces (ids) of a text whose characters are all pieces."""
        n = len(text)
        whole = self.id_of.get(text)
        if whole is not None and (n == 1 or self.made(whole)):
            return [whole]
        longest = [-1] * n
        for end, (piece, size) in self.trie.iter(text):
            longest[end - size + 1] = piece                 # ends ascend, so the longest stays
        taken: list[int] = []
        at, failed, piece, last = 0, 0, longest[0], -1
        sizes, shorter, pairs, many = self.size, self.shorter, self._pairs, self.n
        while at < n:
            while piece >= 0:
                end = at + sizes[piece]
                if not failed >> end & 1:
                    fits = pairs.get(last * many + piece)
                    if fits or fits is None and self.compatible(last, piece):
                        break
                piece = shorter[piece]
            if piece >= 0:
                taken.append(piece)
                at, last = end, piece
                piece = longest[at] if at < n else -1
            else:
                failed |= 1 << at
                piece = taken.pop()
                at -= sizes[piece]
                piece, last = shorter[piece], taken[-1] if taken else -1
        return taken

    def _encode_parts(self, texts: list[str]) -> list[bytes]:
        return [array("i", self.segment(t)).tobytes() for t in texts]

    def _encode_units(self, units: list[bytes]) -> list[bytes]:
        """Ids of runs that no merge crosses: cut where no piece spans two
        neighbouring characters; characters in no piece become bytes."""
        bridges, whole, cut = self._bridges, [], {}
        for k, unit in enumerate(units):
            text = unit.decode().replace(" ", MARK)
            whole.append(text)
            if not bridges.issuperset(map(add, text, text[1:])):
                at = [i for i, pair in enumerate(map(add, text, text[1:]), 1) if pair not in bridges]
                cut[k] = [text[i:j] for i, j in zip([0, *at], [*at, len(text)])]
        parts = dict.fromkeys(chain((t for k, t in enumerate(whole) if k not in cut), *cut.values()))
        known = [t for t in parts if len(t) > 1 or t in self.id_of]
        parts.update(zip(known, self._part.all(known)))
        for t, v in parts.items():
            if v is None:
                parts[t] = array("i", [self.bytes_id[b] for b in t.encode("utf-8", "surrogatepass")]).tobytes()
        return [b"".join(map(parts.__getitem__, cut[k])) if k in cut else parts[t] for k, t in enumerate(whole)]

    def units(self, texts: list[bytes]) -> tuple[Units, list[bytes]]:
        """The units of some texts and the ids (32-bit integers) of each
        distinct one.  A text begins with a space mark; every other unit begins
        at the first of the spaces before it."""
        mark = MARK.encode()
        found = Units([b" " + t.replace(mark, b" ") if t else b"" for t in texts],
                      lambda raw: (raw[1:-1] == 32) & (raw[:-2] != 32))
        return found, self._unit.all(found.distinct)

    def encode(self, text: str | None) -> list[int]:
        found, values = self.units([(text or "").encode()])
        return found.joined(values, np.int32)[0].tolist()

    def unit_texts(self, values: list[bytes]) -> tuple[bytes, np.ndarray]:
        """What the ids of units stand for, with their leading spaces, one after
        the other, and the length of each in bytes."""
        flat = np.frombuffer(b"".join(values), np.int32)
        n = np.fromiter(map(len, values), np.int64, len(values)) // 4
        raw = b"".join(map(self.id_bytes.__getitem__, flat.tolist()))
        upto = np.concatenate(([0], np.cumsum(self.id_width[flat])))[np.concatenate(([0], np.cumsum(n)))]
        try:
            raw.decode()
        except UnicodeDecodeError:
            # a broken run of bytes ends with its unit, for the next one begins with a space
            texts = [b" " + self._decode_broken(array("i", v)).encode() if v else b"" for v in values]
            return b"".join(texts), np.fromiter(map(len, texts), np.int64, len(texts))
        return raw, np.diff(upto)

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.id_bytes.__getitem__, ids))
        if ids and raw[:1] == b" " and ids[0] not in self.byte_of:
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self._decode_broken(ids)

    def _decode_broken(self, ids: list[int]) -> str:
        """Byte pieces that are not UTF-8 become U+FFFD one by one."""
        out, run = [], b""
        for k, i in enumerate(list(ids) + [-1]):
            if i in self.byte_of:
                run += self.id_bytes[i]
                continue
            while run:
                for size in (1, 2, 3, 4):
                    try:
                        out.append(run[:size].decode())
                        run = run[size:]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    run = run[1:]
            if i >= 0:
                piece = self.id_bytes[i].decode()
                out.append(piece[1:] if k == 0 and piece[:1] == " " else piece)
        return "".join(out)


@lru_cache(maxsize=2)
def coder(path: str) -> PieceBpe:
    """One coder per worker process and model file."""
    return PieceBpe(path)


def encode(docs: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
           decoded: bool = False) -> DataFrame:
    """``keep`` columns, ``ids`` and, if asked for, the text ``decoded`` from
    them in the same pass.  ``model`` is a path that every worker can read."""
    kept = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    schema = kept.drop("_text").selectExpr("*", "cast(null as array<int>) ids", *(["'' decoded"] if decoded else [])).schema

    def run(batches):
        bpe = coder(model)
        for b in batches:
            for at, texts in slices(b.column(b.num_columns - 1)):
                found, values = bpe.units(texts)
                flat, end = found.joined(values, np.int32)
                cols = [c.slice(at, len(texts)) for c in b.columns[:-1]]
                cols.append(pa.ListArray.from_arrays(pa.array(end, pa.int32()), pa.array(flat)))
                if decoded:
                    # the first piece of a text has a space mark that is none of it
                    whole = found.texts(*bpe.unit_texts(values))
                    cols.append(pa.array([t[1:].decode() for t in whole], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)
    return kept.mapInArrow(run, schema)


def decode(coded: DataFrame, model: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the ``text`` of the ids."""
    kept = coded.select(*keep, F.col(ids).alias("_ids"))
    schema = kept.drop("_ids").selectExpr("*", "'' text").schema

    def run(batches):
        bpe = coder(model)
        for whole in batches:
            for i in range(0, whole.num_rows, OUT_ROWS):
                b = whole.slice(i, OUT_ROWS)
                texts = [bpe.decode(x.as_py() or []) for x in b.column(b.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(b.columns[:-1] + [pa.array(texts, pa.string())], names=schema.names)
    return kept.mapInArrow(run, schema)


def digests(coded: DataFrame) -> DataFrame:
    """n_tokens and the hashes of the ids and of the decoded text."""
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))
