"""Shingles of texts and band keys of MinHash signatures."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _mix_in(x: np.ndarray, scratch: np.ndarray) -> None:
    """:func:`mixed` in place."""
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None)):
        np.right_shift(x, np.uint64(shift), out=scratch)
        np.bitwise_xor(x, scratch, out=x)
        if times:
            np.multiply(x, np.uint64(times), out=x)


#: Hashes that are worked on at once: they stay in a core's cache.
CHUNK = 1 << 14


def least_hashes(h: np.ndarray, begin: np.ndarray, hashes: int) -> np.ndarray:
    """(sets, hashes): of each set, which begins at ``begin`` in ``h``, the least of its numbers under each hash. No set is empty."""
    out = np.full((hashes, len(begin)), np.iinfo(np.uint64).max, np.uint64)
    x, scratch = (np.empty(min(CHUNK, len(h)), np.uint64) for _ in range(2))
    for i in range(0, len(h), CHUNK):
        part = h[i : i + CHUNK]
        first, last = np.searchsorted(begin, i, "right") - 1, np.searchsorted(begin, i + len(part))
        at = np.maximum(begin[first:last] - i, 0)
        for k in range(hashes):
            now = x[: len(part)]
            np.add(part, np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1), out=now)
            _mix_in(now, scratch[: len(part)])
            np.minimum(out[k, first:last], np.minimum.reduceat(now, at), out=out[k, first:last])
    return out.T


def signed(bands: int, rows: int):
    """Arrow function: array of distinct shingle hashes to the keys of its bands and a digest of its contents; the sets of a batch are hashed together."""

    @F.arrow_udf("keys array<bigint>, content binary")
    def run(shingles: pa.Array) -> pa.Array:
        size = pc.fill_null(pc.list_value_length(shingles), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = shingles.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        some = np.flatnonzero(size)
        begin = (np.cumsum(size) - size)[some]
        least = least_hashes(flat.view(np.uint64), begin, bands * rows) if len(some) else np.zeros((0, bands * rows), np.uint64)
        key = np.zeros((len(some), bands), np.uint64)
        for b in range(bands):
            for r in range(rows):
                key[:, b] = mixed((key[:, b] ^ least[:, b * rows + r]) + np.uint64(b + 1))
        contents: list[bytes | None] = [None] * len(size)
        for i, at, n in zip(some.tolist(), begin.tolist(), size[some].tolist()):
            contents[i] = hashlib.blake2b(np.sort(flat[at : at + n]).tobytes(), digest_size=16).digest()
        offsets = np.concatenate([[0], np.cumsum(np.where(size > 0, bands, 0))])
        keys = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(key.view(np.int64).ravel()), mask=pa.array(size == 0))
        return pa.StructArray.from_arrays([keys, pa.array(contents, pa.binary())], ["keys", "content"])

    return run


_P = [np.uint64(x) for x in (0, 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def _step(x: np.ndarray) -> np.ndarray:
    return _turned(x * _P[2], 31) * _P[1]


def xxhash64(data: np.ndarray, begin: np.ndarray, size: np.ndarray, seed: int = 42) -> np.ndarray:
    """Spark's ``xxhash64`` of many stretches of bytes; eight more bytes follow the last one."""
    eight, four = (np.ndarray((len(data) - 7,), kind, data, strides=(1,)) for kind in ("<u8", "<u4"))
    h, at, rest = np.full(len(begin), np.uint64(seed) + _P[5]), begin.copy(), size.copy()
    some = np.flatnonzero(size >= 32)
    if len(some):
        sums = np.array([seed + int(_P[1]) + int(_P[2]) & (1 << 64) - 1, seed + int(_P[2]) & (1 << 64) - 1, seed, seed - int(_P[1]) & (1 << 64) - 1], np.uint64)
        v, now = np.repeat(sums[:, None], len(some), axis=1), np.arange(len(some))
        while len(now):
            where = at[some[now]]
            for j in range(4):
                v[j, now] = _turned(v[j, now] + eight[where + 8 * j] * _P[2], 31) * _P[1]
            at[some[now]] += 32
            rest[some[now]] -= 32
            now = now[rest[some[now]] >= 32]
        x = _turned(v[0], 1) + _turned(v[1], 7) + _turned(v[2], 12) + _turned(v[3], 18)
        for j in range(4):
            x = (x ^ _step(v[j])) * _P[1] + _P[4]
        h[some] = x
    h += size.astype(np.uint64)
    while len(some := np.flatnonzero(rest >= 8)):
        h[some] = _turned(h[some] ^ _step(eight[at[some]]), 27) * _P[1] + _P[4]
        at[some] += 8
        rest[some] -= 8
    some = np.flatnonzero(rest >= 4)
    h[some] = _turned(h[some] ^ four[at[some]].astype(np.uint64) * _P[1], 23) * _P[2] + _P[3]
    at[some] += 4
    rest[some] -= 4
    while len(some := np.flatnonzero(rest > 0)):
        h[some] = _turned(h[some] ^ data[at[some]].astype(np.uint64) * _P[5], 11) * _P[1]
        at[some] += 1
        rest[some] -= 1
    h = (h ^ h >> np.uint64(33)) * _P[2]
    h = (h ^ h >> np.uint64(29)) * _P[3]
    return h ^ h >> np.uint64(32)


def shingles(k: int):
    """Arrow function: words joined by blanks to the distinct hashes of their runs of ``k`` words, or of all words where they are fewer.

    A run's hash is Spark's ``xxhash64`` of its words joined by blanks.
    """

    @F.arrow_udf("array<bigint>")
    def run(texts: pa.Array) -> pa.Array:
        n = len(texts)
        length = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        data = np.frombuffer(b"".join(x for x in texts.cast(pa.binary()).to_pylist() if x) + bytes(8), np.uint8)
        off = np.concatenate([[0], np.cumsum(length)])
        some = np.flatnonzero(length)
        blank = np.flatnonzero(data[: off[-1]] == 32)
        start, stop = np.sort(np.concatenate([off[some], blank + 1])), np.sort(np.concatenate([blank, off[some + 1]]))
        first, last = np.searchsorted(start, off[some]), np.searchsorted(start, off[some + 1])
        runs = np.maximum(1, last - first - k + 1)
        ends = np.cumsum(runs)
        at = np.repeat(first - (ends - runs), runs) + np.arange(ends[-1] if len(ends) else 0)
        begin, end = start[at], stop[np.minimum(at + k, np.repeat(last, runs)) - 1]
        parts = [xxhash64(data, begin[i : i + CHUNK], (end - begin)[i : i + CHUNK]) for i in range(0, len(at), CHUNK)]
        h = (np.concatenate(parts) if parts else np.zeros(0, np.uint64)).view(np.int64)
        out = [np.unique(h[a:b]) for a, b in zip((ends - runs).tolist(), ends.tolist())]
        sizes = np.zeros(n, np.int64)
        sizes[some] = [len(x) for x in out]
        flat = pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), flat, mask=texts.is_null())

    return run
