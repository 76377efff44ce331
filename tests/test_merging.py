"""Merges of many places at once change counts as those of few do."""

import random

import pyarrow as pa
import pytest

from corpusloom.operators import bpe


@pytest.mark.parametrize("letters", ["a", "ab", "aaab", "abcdef"])
def test_sums_by_symbol_change_nothing(monkeypatch, letters):
    rng = random.Random(letters)
    for _ in range(40):
        table = [("".join(rng.choice(letters) for _ in range(rng.randrange(1, 30))), rng.randrange(1, 9)) for _ in range(30)]
        want = bpe.learn(table, 60)
        with monkeypatch.context() as m:
            m.setattr(bpe.by_symbol, "__defaults__", (0,))
            assert bpe.learn(table, 60) == want


def test_counts_follow_merges():
    # after each merge the changed counts are those of counting all pairs anew
    np, rng = bpe.np, random.Random(3)
    words = ["".join(rng.choice("aab") for _ in range(rng.randrange(1, 20))) for _ in range(60)]
    places = bpe.Places(pa.array(words), np.arange(1, 61), np.array([97, 98], np.uint32))
    count = dict(zip(*(x.tolist() for x in places.pairs())))
    for result in range(2, 12):
        pair = max(count, key=count.get)
        for k, d in zip(*(x.tolist() for x in places.merge(pair >> 32, pair & 0xFFFFFFFF, result))):
            count[k] = count.get(k, 0) + d
        fresh = bpe.summed(*(lambda at, key: (key, places.freq[at]))(*places.keyed(np.arange(len(places.symbol)))))
        assert {k: n for k, n in count.items() if n} == dict(zip(*(x.tolist() for x in fresh)))
        count = {k: n for k, n in count.items() if n}
