"""Pretokens found in the bytes of many texts are those of the regular expression."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import pretokens
from corpusloom.functions import text as tx
from corpusloom.operators import bpe, counts

POOL = [*"ab1 2 \t\n'—é́‌‍ 　▁😀𝒳१²\x0b\x1c\x85\x00;,", "  ", " \n", "\U000e0100", " "]


def texts(n):
    rng = random.Random(n)
    return [None, "", " ", "\n\n", *("".join(rng.choice(POOL) for _ in range(rng.randrange(0, 14))) for _ in range(n)), None, "", "a" * 3000]


@pytest.mark.parametrize("segment", [1, 200, 1 << 19])
def test_the_same_as_the_regular_expression(spark, monkeypatch, segment):
    monkeypatch.setattr(pretokens, "SEGMENT", segment)
    rows = texts(2000)
    df = spark.createDataFrame(list(enumerate(rows)), "i int, text string").orderBy("i")
    want = [r.w for r in df.select(tx.raw_pretokens(F.col("text")).alias("w")).collect()]
    joined = [r.j for r in df.select(tx.joined_pretokens(F.col("text")).alias("j")).collect()]
    find = pretokens.Pretokenizer(pretokens.kinds(spark))
    for skip in (0, 3):
        words, number = find(pa.array(rows)[skip:])
        words.validate(full=True)
        words = iter(words.to_pylist())
        got = [[next(words) for _ in range(n)] for n in number.tolist()]
        assert got == [w or [] for w in want[skip:]] and next(words, None) is None
    assert joined == [w and "".join(w).replace(" ", tx.MARK) if w else t and "" for w, t in zip(want, rows)]


def test_counts_of_each_language(spark):
    rows = [(lang, t) for lang, t in zip(["en", "de", None] * 900, texts(800))]
    docs = spark.createDataFrame(rows, "lang string, text string")
    plain = docs.select("lang", F.explode(tx.pretokens(F.col("text"))).alias("word"))
    order = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert order(counts.language_words(docs)) == order(plain.groupBy("lang", "word").agg(F.count("*").alias("freq")))
    assert order(counts.word_frequencies(docs)) == order(plain.groupBy("word").agg(F.count("*").alias("freq")))
    assert counts.word_frequencies(docs.where("false")).collect() == []


def test_no_lists_of_matches_are_made(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts(300))], "doc_id int, text string")
    words = counts.word_frequencies(docs)
    tokenizer = bpe.Tokenizer.of(counts.base_vocabulary(words), bpe.train(words, 30, known=tuple(counts.SPECIALS)))
    own = lambda text: tx.pretokens(text)
    for f in (bpe.encode, bpe.tokenized):
        fast, slow = f(docs, tokenizer), f(docs, tokenizer, own)
        for df, lists in ((fast, False), (slow, True)):
            assert ("regexp_extract_all" in df._jdf.queryExecution().optimizedPlan().toString()) == lists
        assert fast.columns == slow.columns and sorted(fast.collect()) == sorted(slow.collect())
    back = bpe.round_trip(docs, tokenizer).orderBy("doc_id").collect()
    assert [r.decoded for r in back] == [r.decoded for r in bpe.tokenized(docs, tokenizer, own).orderBy("doc_id").collect()]
    for df in (words, counts.language_words(docs.withColumn("lang", F.lit("en"))), bpe.evaluate(docs.withColumn("lang", F.lit("en")), tokenizer)):
        assert "regexp_extract_all" not in df._jdf.queryExecution().optimizedPlan().toString()
