"""Pairs that are too rare for a rule aren't sorted to find that out, and rules are the same whatever the buckets."""

import numpy as np

from corpusloom.llm import tokens


def sorted_pairs(monkeypatch, seq, **more):
    sizes, unique = [], np.unique
    with monkeypatch.context() as m:
        m.setattr(np, "unique", lambda x, **k: (sizes.append(len(x)), unique(x, **k))[1])
        found = tokens.repair(seq, 50_000, tokens.PAYS, **more)
    return sum(sizes), found


def test_rare_pairs(monkeypatch):
    rng = np.random.default_rng(4)
    seq = rng.integers(0, 50_000, 400_000).astype(np.int32)
    seq[::1000] = -1
    seq[5000:5300] = np.tile([1, 2, 3], 100)
    n, found = sorted_pairs(monkeypatch, seq)
    assert n < len(seq) / 2  # 260,173 where rare pairs share buckets
    for buckets in (1 << 10, 1 << 22):
        for a, b in zip(found, sorted_pairs(monkeypatch, seq, buckets=buckets)[1]):
            assert np.array_equal(a, b)
    assert len(found[1]) > 5
