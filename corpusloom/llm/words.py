"""Words of many texts at once, hashed in numpy on the Arrow buffer.

A word is a run of ASCII letters, digits and characters beyond ASCII, in lower case; everything else
separates. ``WORD`` is the same rule as a regular expression.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD = re.compile("[0-9a-z\u0080-\U0010ffff]+")
_P = 0x9E3779B97F4A7C15 | 1
_INV = pow(_P, -1, 1 << 64)
_SEG = 1 << 20
_SEP = np.ones(256, bool)
_SEP[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VAL = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
_pow: tuple[np.ndarray, np.ndarray] | None = None


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow
    if _pow is None or len(_pow[0]) < n:
        n = max(n, _SEG + 4096)
        a, b = np.full(n, _P, np.uint64), np.full(n, _INV, np.uint64)
        a[0] = b[0] = 1
        _pow = np.multiply.accumulate(a), np.multiply.accumulate(b)
    return _pow


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the n + 1 offsets of texts without nulls."""
    texts = texts.cast(pa.large_string())
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def as_texts(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array of strings, with empty strings for nulls."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return pc.fill_null(col.cast(pa.large_string()), "")


@dataclass
class Words:
    """Words of n texts: hashes, byte spans in ``buf``, and ``first[i]:first[i + 1]`` are those of text i."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    buf: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(texts: pa.Array, hashed: bool = True) -> Words:
    buf, off = text_buffer(pc.utf8_lower(as_texts(texts)))
    starts, ends, hashes, at, n = [], [], [], 0, len(buf)
    edge = off[1:-1]
    while at < n:
        stop = min(n, at + _SEG)
        while stop < n and not _SEP[buf[stop]]:  # never cut a word; a text boundary also ends one
            k = np.searchsorted(edge, stop)
            if k < len(edge) and edge[k] == stop:
                break
            more = _SEP[buf[stop : stop + 4096]]
            near = int(edge[k]) if k < len(edge) else n
            step = int(more.argmax()) if more.any() else len(more)
            stop = min(stop + step, near)
        seg = buf[at:stop]
        word = ~_SEP[seg]
        before = np.zeros(len(seg) + 1, bool)
        before[1:] = word
        after = np.zeros(len(seg) + 1, bool)
        after[:-1] = word
        cuts = edge[np.searchsorted(edge, at) : np.searchsorted(edge, stop, "right")] - at
        before[cuts] = False
        s = np.flatnonzero(word & ~before[:-1])
        shut = after[1:].copy()
        shut[cuts[cuts > 0] - 1] = False
        e = np.flatnonzero(word & ~shut) + 1
        if hashed and len(s):
            up, down = _powers(len(seg) + 1)
            run = np.zeros(len(seg) + 1, np.uint64)
            np.cumsum(_VAL[seg] * up[: len(seg)], out=run[1:])
            hashes.append(mix((run[e] - run[s]) * down[s]))
        starts.append(s + at)
        ends.append(e + at)
        at = stop
    cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    start = cat(starts, np.int64)
    return Words(cat(hashes, np.uint64), start, cat(ends, np.int64), np.searchsorted(start, off), buf)


def chunks(texts: pa.Array, size: int = 1 << 21) -> list[tuple[int, int]]:
    """Ranges of rows with about ``size`` bytes of text each; a longer text is alone in its range."""
    _, off = text_buffer(texts)
    out, i = [], 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        out.append((i, j))
        i = j
    return out


def text_hash(texts: pa.Array) -> np.ndarray:
    """A 64-bit hash of each whole text."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in texts.to_pylist()), np.uint64, len(texts))


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k successive words by the index of the first, and how many each text has."""
    n = len(w.hash)
    count = np.maximum(np.diff(w.first) - k + 1, 0)
    if n < k:
        return np.zeros(0, np.uint64), count
    g = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        g = g * np.uint64(_P) + w.hash[j : n - k + 1 + j]
    return mix(g), count


class Spans:
    """Disjoint spans, each taken only if it overlaps none before it."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def take(self, a: int, b: int) -> bool:
        i = bisect_right(self.starts, a)
        if (i and self.ends[i - 1] > a) or (i < len(self.starts) and self.starts[i] < b):
            return False
        self.starts.insert(i, a)
        self.ends.insert(i, b)
        return True
