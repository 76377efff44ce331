"""Merges learned in one task, in rounds over a table, and by plain counting are the same."""

import random

import pytest

from corpusloom.operators import bpe, counts
from test_bpe_vocabulary import plain


def words(rng, letters, n, longest):
    return {"".join(rng.choice(letters) for _ in range(rng.randrange(1, longest))): rng.randrange(1, 9) for _ in range(n)}


@pytest.mark.parametrize("letters", ["ab", "abc", "abcdefgh", "aaab", "xyéß𝄞"])
def test_rounds_take_what_comes_up_anyway(letters):
    rng = random.Random(len(letters))
    for _ in range(25):
        table = words(rng, letters, 25, 9)
        base = {*counts.SPECIALS, *"".join(table)}
        want = plain(table, len(base) + 60, base)
        assert bpe.learn(table.items(), 60, known=tuple(counts.SPECIALS)) == want
        # the rounds by plain counting of all pairs
        now, got = [(list(w), n) for w, n in table.items()], []
        while True:
            count = {}
            for s, n in now:
                for p in zip(s, s[1:]):
                    count[p] = count.get(p, 0) + n
            best = sorted(((a, b, n) for (a, b), n in count.items() if n >= 2), key=lambda x: (-x[2], x[0], x[1]))[:12]
            taken = bpe.successive(best, 12) if best else []
            if not taken:
                break
            for a, b, _ in taken:
                got.append((a, b))
                now = [(bpe.merged(s, a, b), n) for s, n in now]
        assert got[: len(want)] == want or got == want[: len(got)]


def test_both_ways_on_a_table(spark):
    rng = random.Random(7)
    table = words(rng, "abcdefghijklmnop", 400, 12)
    df = spark.createDataFrame(list(table.items()), "word string, freq bigint")
    known = tuple(counts.SPECIALS)
    one = [tuple(r) for r in bpe.train(df, 40, known=known).orderBy("rank").collect()]
    two = [tuple(r) for r in bpe.train(df, 40, known=known, local_words=0, write_every=3).orderBy("rank").collect()]
    assert one == two and len({r[3] for r in one}) == 40


def test_tasks_together_on_a_table(spark):
    rng = random.Random(9)
    table = words(rng, "abcdefgh", 600, 10)
    df = spark.createDataFrame(list(table.items()), "word string, freq bigint")
    known = tuple(counts.SPECIALS)
    one = [tuple(r) for r in bpe.train(df, 200, known=known).orderBy("rank").collect()]
    # too many words for one task, few enough for four
    many = bpe.train(df, 200, known=known, local_words=len(table) // 2)
    assert spark.sparkContext.defaultParallelism == 4 and "MapInArrow" in many._jdf.queryExecution().toString()
    assert [tuple(r) for r in many.orderBy("rank").collect()] == one and len(one) > 190


def test_empty_parts_take_part(spark):
    df = spark.createDataFrame([("abab", 3), ("abc", 2)], "word string, freq bigint")
    got = bpe.train(df, 5, local_words=1)
    assert [(r.left, r.right) for r in got.orderBy("rank").collect()] == [("a", "b"), ("ab", "ab"), ("ab", "c")]
