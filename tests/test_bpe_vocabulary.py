"""Training reaches the reference's vocabulary, and merges what a plain version merges."""

import random
from collections import Counter

from corpusloom.operators import bpe, counts
from corpusloom.plans import bpe_plans

D = "/root/testdata/sf0.001"


def plain(table, size, vocab):
    """All pairs counted anew before each merge, until there are ``size`` tokens."""
    words, vocab, out = [(list(w), n) for w, n in table.items()], set(vocab), []
    while len(vocab) < size:
        count = Counter()
        for s, n in words:
            for p in zip(s, s[1:]):
                count[p] += n
        best = min(count, key=lambda p: (-count[p], p), default=None)
        if best is None or count[best] < 2:
            break
        out.append(best)
        vocab.add(best[0] + best[1])
        words = [(bpe.merged(s, *best), n) for s, n in words]
    return out


def test_learning_against_plain_counting():
    rng = random.Random(8)
    for _ in range(60):
        table = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))): rng.randrange(1, 9) for _ in range(30)}
        base = {*counts.SPECIALS, *"".join(table)}
        assert bpe.learn(table.items(), 40, known=tuple(counts.SPECIALS)) == plain(table, len(base) + 40, base)


def test_queries_train_to_the_target(spark):
    vocab = {r.token: r.id for r in bpe_plans.bpe_vocabulary(spark, D).collect()}
    assert len(vocab) == bpe_plans.VOCABULARY == 10_000
    merges = bpe_plans.bpe_merges(spark, D).collect()
    assert len(merges) > 9_000 and {r.result for r in merges} <= set(vocab)
    assert bpe_plans.bpe_roundtrip(spark, D).where("NOT same").count() == 0
