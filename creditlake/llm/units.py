"""Texts as sequences of units (words with the spaces before them) that a coder
encodes on their own, each distinct one of some megabytes of text once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: bytes of text cut into units at once, if one text is not longer
SLICE_BYTES = 1 << 21
#: bytes of a generation of a memory (two are held)
MEMO_BYTES = 40 << 20
#: entries put into a memory at once
MEMO_STEP = 4096
#: what an entry of a memory takes besides its key and value
ENTRY_BYTES = 200
#: longer keys are computed anew each time
MEMO_KEY = 64


class Memo:
    """Values by key, computed where they are lacking; what was not used lately
    is forgotten: when the entries take ``most`` bytes, they become the old
    generation.  Keys and values are bytes or strings."""

    def __init__(self, make: Callable[[list], list], most: int = MEMO_BYTES):
        """``make``: values for a list of keys."""
        self._make, self._most, self._new, self._old, self._held = make, most, {}, {}, 0

    def __len__(self) -> int:
        return len(self._new) + len(self._old)

    def all(self, keys: list) -> list:
        """The values of some (distinct) keys."""
        found = list(map(self._new.get, keys))
        lacking = [i for i, v in enumerate(found) if v is None]
        if not lacking:
            return found
        asked = [keys[i] for i in lacking]
        values = list(map(self._old.get, asked))
        unknown = [i for i, v in enumerate(values) if v is None]
        if unknown:
            for i, v in zip(unknown, self._make([asked[i] for i in unknown])):
                values[i] = v
        for i, v in zip(lacking, values):
            found[i] = v
        if max(map(len, asked)) > MEMO_KEY:
            short = [i for i, k in enumerate(asked) if len(k) <= MEMO_KEY]
            asked, values = [asked[i] for i in short], [values[i] for i in short]
        for i in range(0, len(asked), MEMO_STEP):
            k, v = asked[i:i + MEMO_STEP], values[i:i + MEMO_STEP]
            self._held += ENTRY_BYTES * len(k) + sum(map(len, k)) + sum(map(len, v))
            if self._held > self._most:
                self._old, self._new, self._held = self._new, {}, 0
            self._new.update(zip(k, v))
        return found


def slices(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first, texts in UTF-8) of runs of texts; null is empty."""
    at, run, size = 0, [], 0
    for i, t in enumerate(texts.cast(pa.large_binary()) if len(texts) else ()):
        t = t.as_py() or b""
        run.append(t)
        size += len(t)
        if size >= SLICE_BYTES:
            yield at, run
            at, run, size = i + 1, [], 0
    if run:
        yield at, run


class Units:
    """The units of some texts: ``distinct`` ones, the number ``codes`` of each
    place, and ``begin``, the place where each text begins (and the end)."""

    def __init__(self, texts: list[bytes], starts: Callable[[np.ndarray], np.ndarray]):
        """``starts``: for bytes (and one space before and after) where a unit
        begins, besides at the beginning of a text."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        edge = np.concatenate(([0], np.cumsum(size)))
        raw = np.frombuffer(b" " + b"".join(texts) + b" ", np.uint8)
        first = np.zeros(len(raw) - 1, bool)
        first[:-1] = starts(raw)
        first[edge[:-1]] = True
        first = first[:-1]
        at = np.flatnonzero(first)
        self.begin = np.searchsorted(at, edge)
        if not len(at):
            self.distinct, self.codes = [], np.zeros(0, np.int64)
            return
        spots = pa.Array.from_buffers(pa.large_binary(), len(at), [
            None, pa.py_buffer(np.append(at, edge[-1]).astype(np.int64)), pa.py_buffer(raw[1:-1].tobytes())])
        coded = spots.dictionary_encode()
        self.distinct = coded.dictionary.to_pylist()
        self.codes = coded.indices.to_numpy().astype(np.int64)

    def joined(self, values: list[bytes], kind: type) -> tuple[np.ndarray, np.ndarray]:
        """(flat, end): the values of all places one after the other, and where
        each text's values begin in it (and the end)."""
        flat = np.frombuffer(b"".join(values), kind)
        width = np.fromiter(map(len, values), np.int64, len(values)) // np.dtype(kind).itemsize
        begin = np.cumsum(width) - width
        n = width[self.codes]
        end = np.concatenate(([0], np.cumsum(n)))
        places = np.repeat((begin[self.codes] - end[:-1]).astype(np.int64), n) + np.arange(end[-1])
        return flat[places], end[self.begin]

    def texts(self, values: bytes, width: np.ndarray) -> list[bytes]:
        """The values, given one after the other with their lengths, of all
        places of each text."""
        if not len(width):
            return [b""] * (len(self.begin) - 1)
        offsets = np.concatenate(([0], np.cumsum(width))).astype(np.int64)
        spots = pa.Array.from_buffers(pa.large_binary(), len(width), [None, pa.py_buffer(offsets), pa.py_buffer(values)])
        spots = spots.take(pa.array(self.codes))
        _, offsets, data = spots.buffers()
        end = np.frombuffer(offsets, np.int64, len(spots) + 1, 8 * spots.offset)[self.begin]
        data = memoryview(data) if data is not None else b""
        return [bytes(data[a:b]) for a, b in zip(end[:-1], end[1:])]
