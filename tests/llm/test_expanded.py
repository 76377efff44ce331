"""Codes of dropped rules are expanded at once."""

import numpy as np
import pytest

from corpusloom.llm import tokens


def plain(seq, rules, base, n):
    out = []
    for c in seq:
        out += plain(rules[c - base], rules, base, n) if c >= base + n else [c]
    return out


@pytest.mark.parametrize("n", [0, 1, 7, 30])
def test_as_one_by_one(n):
    rng, base = np.random.default_rng(n), 20
    rules = np.array([rng.integers(0, base + i, 2) for i in range(30)], np.uint32)
    for size in (0, 1, 200):
        seq = rng.integers(-1, base + 30, size).astype(np.int32)
        got = tokens.expanded(seq, rules, base, n)
        assert got.dtype == np.int32 and got.tolist() == plain(seq.tolist(), rules.tolist(), base, n)
