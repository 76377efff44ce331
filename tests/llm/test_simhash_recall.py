"""Pairs at the threshold are found whatever the corpus' size and the buckets'."""

import numpy as np
import pytest

from corpusloom.llm import simhash_dedup as sd


def at_distance(n, d, rng):
    fp = rng.integers(0, 1 << 63, (n, sd.WORDS), dtype=np.uint64)
    flat = np.unpackbits(fp.view(np.uint8), axis=1, bitorder="little")
    for row in flat:
        row[rng.permutation(sd.BITS)[:d]] ^= 1
    return fp, np.packbits(flat, axis=1, bitorder="little").view(np.uint64)


@pytest.mark.parametrize("n", [10_000, 200_000, 12_000_000, 1 << 34])
def test_recall_at_the_threshold(n):
    x, y = at_distance(3000, 40, np.random.default_rng(1))
    differ = np.unpackbits((x ^ y).view(np.uint8), axis=1, bitorder="little")
    bits, _ = sd.sampled_bits(n, 24, 7)
    found = np.any([differ[:, at].sum(axis=1) == 0 for at in bits], axis=0)
    assert found.mean() >= 0.88


def test_recall_in_a_large_bucket():
    rng = np.random.default_rng(2)
    x, y = at_distance(3000, 40, rng)
    fp, doc = np.concatenate([x, y]), np.arange(6000)
    more = np.array([rng.permutation(sd.BITS)[:240]])
    for cap in (1000, 50, 10_000):
        a, b = sd._joined(doc, fp, np.zeros(6000, np.int64), np.zeros(6000, np.int64), more, cap, 1, 40)
        low, high = np.minimum(a, b), np.maximum(a, b)
        assert len(set(low[high - low == 3000].tolist())) >= 0.93 * 3000
