"""Short words are encoded in blocks, and decoded once for all texts of a batch."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import bpe


def plain(ranks, word):
    s = list(word)
    while len(s) > 1:
        rank, pair = min((ranks.get(p, 1 << 30), p) for p in zip(s, s[1:]))
        if rank == 1 << 30:
            break
        s = bpe.merged(s, *pair)
    return s


def pieces(coder, words):
    sym, size = coder.fresh(words)
    texts = iter(coder.texts(sym).to_pylist())
    return [[next(texts) for _ in range(n)] for n in size.tolist()]


def test_a_pair_that_comes_up_before_the_merged_one():
    ranks = {("pq", "p"): 0, ("p", "q"): 1}
    coder = bpe.Coder(bpe.Tokenizer(ranks, {"p": 0, "q": 1, "pq": 2, "pqp": 3}))
    assert pieces(coder, ["pqpq"]) == [plain(ranks, "pqpq")] == [["pq", "pq"]]
    s = bpe.np.array([[0, 0], [1, 1], [0, -5], [1, -5], [-5, -5]], bpe.np.int32)
    assert coder._block(s).tolist() == [True, False]


@pytest.mark.parametrize("block", [1, 7, 8192])
def test_blocks_against_plain_encoding(monkeypatch, block):
    monkeypatch.setattr(bpe, "BLOCK", block)
    rng = random.Random(block)
    for letters in ("a", "ab", "abc", "aé𝄞▁z"):
        for _ in range(8):
            known, ranks = list(letters), {}
            for rank in rng.sample(range(1000), 40):  # in no order: a token may be there before what it is made of
                pair = rng.choice(known), rng.choice(known)
                if pair not in ranks and len(pair[0] + pair[1]) < 12:
                    ranks[pair] = rank
                    known.append(pair[0] + pair[1])
            tokenizer = bpe.Tokenizer(ranks, {t: i for i, t in enumerate(dict.fromkeys(["<unk>", *known]))})
            words = ["".join(rng.choice(letters + "?") for _ in range(rng.choice([0, 1, 2, 5, 9, 31, 32, 33, 70, 201]))) for _ in range(60)]
            want = [plain(ranks, w) for w in words]
            coder = bpe.Coder(tokenizer)
            assert pieces(coder, words) == want
            assert pieces(coder, pa.array(["x", *words])[1:]) == want
    assert pieces(coder, []) == []


def test_ranks_are_found_by_hashing():
    rng = random.Random(1)
    pairs = {(chr(rng.randrange(97, 9000)), chr(rng.randrange(97, 9000))): 0 for _ in range(9000)}
    ranks = {p: i for i, p in enumerate(pairs)}
    names = sorted({x for p in pairs for x in (*p, "".join(p))})
    coder = bpe.Coder(bpe.Tokenizer(ranks, {t: i for i, t in enumerate(names)}))
    a, b = (bpe.np.array([coder.number[p[k]] for p in pairs], bpe.np.int32) for k in (0, 1))
    assert coder._ranks(a, b).tolist() == list(range(len(pairs))) and len(coder.levels) > 1
    some = coder._ranks(a, bpe.np.roll(b, 1)).tolist()
    name = {i: t for t, i in coder.number.items()}
    assert some == [ranks.get((name[x], name[y]), coder.NONE) for x, y in zip(a.tolist(), bpe.np.roll(b, 1).tolist())]
    assert (coder._ranks(-a - 2, b) == coder.NONE).all() and (coder._ranks(a, bpe.np.full(len(a), coder.GONE)) == coder.NONE).all()


def test_words_are_decoded_once(spark, monkeypatch):
    tokenizer = bpe.Tokenizer({("▁", "a"): 0}, {"<unk>": 0, "▁": 1, "a": 2, "b": 3, "▁a": 4})
    seen, real = [], bpe._names
    monkeypatch.setattr(bpe, "_names", lambda t: Watched(real(t), seen))
    monkeypatch.setattr(bpe.F, "arrow_udf", lambda kind: lambda f: f)
    run = bpe._of_texts(tokenizer, spark, "decoded")
    got = run(pa.array(["a a  a", None, "", "b? a\n", *["a b"] * 500]))
    assert got.to_pylist() == ["a a a", None, "", "b<unk> a", *["a b"] * 500]
    assert sum(seen) < 20  # not once for each of more than a thousand tokens


class Watched:
    def __init__(self, names, seen):
        self.names, self.seen = names, seen

    def take(self, ids):
        self.seen.append(len(ids))
        return self.names.take(ids)


def test_texts_are_compared_where_they_are_decoded(spark):
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    rng = random.Random(4)
    rows = [None, "", " ", "a ", "\na", *spaces, *(f"a{c}b" for c in spaces), *("".join(rng.choice(["a", "b", "é", " ", "​", "﻿", *spaces[:9], *spaces]) for _ in range(12)) for _ in range(3000))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, text string").coalesce(1)
    want = [r.n for r in docs.select("i", tx.normalize_for_roundtrip(F.col("text")).alias("n")).orderBy("i").collect()]
    assert bpe.normalized(pa.array(rows)).to_pylist() == want
    letters = {c for t in rows for c in t or ""}
    tokenizer = bpe.Tokenizer({("a", "b"): 0}, {t: i for i, t in enumerate(["<unk>", tx.MARK, *sorted(letters), "ab"])})
    back = bpe.round_trip(docs, tokenizer)
    assert "regexp_replace" not in back._jdf.queryExecution().optimizedPlan().toString()
    got = back.orderBy("i").collect()
    assert [r.same for r in got] == [None if n is None else r.decoded == n for n, r in zip(want, got)]
    assert {r.same for r in got} == {None, True, False}
