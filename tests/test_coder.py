"""Many words encoded at once have the pieces that each has by itself."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import bpe
from corpusloom.plans import bpe_plans


def slow(tokenizer, word):
    s = list(word)
    while True:
        first = min(((tokenizer.ranks[p], p) for p in zip(s, s[1:]) if p in tokenizer.ranks), default=None)
        if first is None:
            return s
        s = bpe.merged(s, *first[1])


def trained(rng, letters, merges=60, unknown=True):
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    found = bpe.learn([(w, rng.randrange(1, 9)) for w in words], merges, at_least=1)
    vocab = ["<pad>", "<bos>", "<eos>", *(["<unk>"] if unknown else []), *sorted(set(letters))]
    vocab += [t for t in dict.fromkeys(a + b for a, b in found) if t not in vocab]
    return bpe.Tokenizer({p: i for i, p in enumerate(found)}, {t: i for i, t in enumerate(vocab)})


@pytest.mark.parametrize("letters", ["a", "ab", "abc", "aaab", "abcdefgh", "xyéß𝄞"])
def test_against_one_word_at_a_time(letters):
    rng = random.Random(letters)
    for _ in range(8):
        tokenizer = trained(rng, letters)
        coder = bpe.Coder(tokenizer, remember=150)
        for _ in range(3):
            words = ["".join(rng.choice(letters + "?!") if rng.random() < 0.1 else rng.choice(letters) for _ in range(n)) for n in [0, 1, *(rng.randrange(0, 25) for _ in range(90)), 201, 300]]
            rng.shuffle(words)
            for found in (coder, coder.fresh):
                sym, size = found(words)
                texts, ids = iter(coder.texts(sym).to_pylist()), iter(coder.ids(sym).tolist())
                for w, n in zip(words, size.tolist()):
                    want = slow(tokenizer, w)
                    assert [next(texts) for _ in range(n)] == want == tokenizer.pieces(w)
                    assert [next(ids) for _ in range(n)] == [tokenizer.vocab.get(p, tokenizer.vocab["<unk>"]) for p in want]


def test_no_id_is_told():
    tokenizer = trained(random.Random(1), "ab", unknown=False)
    coder = bpe.Coder(tokenizer)
    with pytest.raises(KeyError):
        coder.ids(coder(["ab?"])[0])


def test_long_words_take_no_square_of_time():
    tokenizer = trained(random.Random(2), "abcd")
    began = time.process_time()
    word = "".join(random.Random(3).choice("abcd") for _ in range(100_000))
    assert "".join(tokenizer.pieces(word)) == word and time.process_time() - began < 20


def test_many_words_at_once():
    rng = random.Random(5)
    tokenizer = trained(rng, "abcdefghijklmnopqrst", 500)
    words = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(10)) for _ in range(100_000)]
    began = time.process_time()
    for i in range(0, len(words), 10_000):
        bpe.Coder(tokenizer).fresh(words[i : i + 10_000])
    assert time.process_time() - began < 3


def test_nulls_and_empty_lists(spark):
    tokenizer = trained(random.Random(4), "abc")
    df = spark.createDataFrame([(1, ["abca", "b"]), (2, None), (3, []), (4, ["b", "abca", "?"])], "k int, w array<string>")
    rows = df.select("k", bpe.word_ids(tokenizer)(F.col("w")).alias("ids"), bpe.word_pieces(tokenizer)(F.col("w")).alias("p")).orderBy("k").collect()
    for r, w in zip(rows, (["abca", "b"], None, [], ["b", "abca", "?"])):
        assert r.ids == (None if w is None else [i for x in w for i in tokenizer.ids(x)])
        assert r.p == (None if w is None else [slow(tokenizer, x) for x in w])
    back = df.select(bpe.word_ids(tokenizer)(F.col("w")).alias("ids"))
    assert sorted(r.decoded or "" for r in bpe.decoded(back, tokenizer).collect()) == sorted(["abcab", "", "", "babca<unk>"])
    assert bpe._joined(tokenizer).func(pa.array([[-1, 10**6], None], pa.list_(pa.int32()))).to_pylist() == ["", None]


def test_merges_are_learned_once(spark, monkeypatch):
    # what is returned is a table: reading it again, or a part of it, learns nothing
    for query in (bpe_plans.bpe_merges, bpe_plans.replicated_merges):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "MapInArrow" not in plan and "FlatMapGroupsInArrow" not in plan
