"""Counting, merges, files, vectors, networks and streams."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import bpe, counts, learning, vectors
from corpusloom.sources import files, sinks
from corpusloom.streaming import running


def words(spark, table):
    return spark.createDataFrame(list(table.items()), "word string, freq bigint")


def test_counts_and_weights(spark):
    docs = spark.createDataFrame([("en", "low low low"), ("en", "lower lower"), ("hi", "low"), ("ta", None)], "lang string, text string")
    assert {r.word: r.freq for r in counts.word_frequencies(docs).collect()} == {"low": 2, "▁low": 2, "lower": 1, "▁lower": 1}
    table = spark.createDataFrame([("en", "a", 9000), ("hi", "b", 1000), ("xx", "!", 5)], "lang string, word string, freq bigint")
    assert {r.lang: r.weight for r in counts.language_weights(table).collect()} == {"en": pytest.approx(0.8333333), "hi": pytest.approx(2.5), "xx": 0.0}
    assert {round(r.weight, 9) for r in counts.language_weights(table, 1.0).where("words > 0").collect()} == {1.0}
    got = spark.createDataFrame([(5, 0.5), (1, 0.1), (10, 2.0), (0, 1.0)], "f bigint, w double").select(counts.scaled(F.col("f"), F.col("w"))).collect()
    assert [r[0] for r in got] == [2, 1, 20, None]


@pytest.mark.parametrize(
    "table, n, want",
    [({"ab": 5, "ac": 3}, 1, [("a", "b")]), ({"tor": 5, "torn": 2, "rust": 1, "mast": 1}, 2, [("o", "r"), ("t", "or")]), ({"ab": 4, "cd": 4}, 1, [("a", "b")]), ({"ab": 1, "cd": 1}, 3, []), ({"aaaa": 3}, 5, [("a", "a"), ("aa", "aa")])],
)
def test_merges(spark, table, n, want):
    for local in (100, 0):
        got = bpe.train(words(spark, table), n, local_words=local).orderBy("rank").collect()
        assert [(r.left, r.right) for r in got] == want


def test_ways_of_training_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20)
    table = counts.word_frequencies(docs)
    assert sorted(bpe.train(table, 12).collect()) == sorted(bpe.train(table, 12, local_words=0, write_every=5).collect())


def test_encode_decode(spark):
    t = bpe.Tokenizer({("l", "o"): 0, ("lo", "w"): 1}, {"<pad>": 0, "<bos>": 1, "<eos>": 2, "<unk>": 3, "l": 4, "o": 5, "w": 6, "▁": 7, "lo": 8, "low": 9})
    docs = spark.createDataFrame([(1, "low  low lx"), (2, ""), (3, None)], "doc_id bigint, text string")
    got = {r.doc_id: (r.ids, r.decoded) for r in bpe.decoded(bpe.encode(docs, t), t).collect()}
    assert got[1] == ([9, 7, 9, 7, 4, 3], "low low l<unk>") and got[2] == ([], "") and got[3][0] is None
    assert t.text([1, 9, 2, 0, 99]) == "low"
    with pytest.raises(KeyError):
        bpe.Tokenizer({}, {"a": 0}).ids("b")
    report = {r.language: r for r in bpe.evaluate(spark.createDataFrame([("en", "low low"), ("xx", "!!!"), ("xx", None)], "lang string, text string"), t).collect()}
    assert report["en"].num_words == 2 and report["en"].fertility == 1.5 and report["en"].roundtrip_ok and report["xx"].fertility == 0.0 and report["xx"].num_unk_tokens == 3


def test_ratio_report(spark):
    rows = spark.createDataFrame([("a", 10, 1.2), ("b", 10, 2.0), ("c", 0, 0.0)], "language string, num_words bigint, fertility double")
    r = bpe.ratio_report(rows, 7).first()
    assert (round(r.difference, 9), r.spread, float(r.assignment_score)) == (0.8, pytest.approx(0.8), pytest.approx(1250.0))
    assert bpe.ratio_report(rows.where("language <> 'b'"), 7).first().assignment_score == "Infinity"


def test_files(spark, tmp_path):
    (tmp_path / "en").mkdir()
    (tmp_path / "en" / "a.txt").write_text("﻿One <b>two</b>", encoding="utf-8")
    (tmp_path / "en" / "b.txt").write_text("<br/>")
    (tmp_path / "en" / "c.md").write_text("no")
    got = files.corpus(spark, str(tmp_path), ["en", "hi"]).collect()
    assert [(r.lang, r.text) for r in got] == [("en", "One two")]
    with pytest.raises(ValueError):
        files.corpus(spark, str(tmp_path), ["hi"])
    assert files.faithful_text(spark, str(tmp_path), "te").count() == 0
    merges = spark.createDataFrame([(1, "lo", "w", "low"), (0, "l", "o", "lo")], bpe.MERGES)
    vocab = spark.createDataFrame([("<pad>", 0), ("é", 1)], "token string, id int")
    for flat in (False, True):
        sinks.write_merges(merges, str(tmp_path / f"m{flat}"), flat)
        back = files.merges(spark, str(tmp_path / f"m{flat}")).collect()
        assert sorted((r.left, r.right, r.result) for r in back) == [("l", "o", "lo"), ("lo", "w", "low")]
    sinks.write_vocabulary(vocab, str(tmp_path / "v"))
    doc = json.loads(next((tmp_path / "v").glob("part*")).read_text(encoding="utf-8"))
    assert doc == {"vocab_size": 2, "special_tokens": {"<pad>": 0}, "tokens": {"0": "<pad>", "1": "é"}}
    assert sorted(tuple(r) for r in files.vocabulary(spark, str(tmp_path / "v")).collect()) == [("<pad>", 0), ("é", 1)]
    body = json.dumps({"query": {"pages": {"1": {"langlinks": [{"lang": "hi", "*": "T"}, {"lang": "fr", "*": "U"}]}}}})
    assert [tuple(r) for r in files.language_links(spark.createDataFrame([(body,)], "body string"), ("hi",)).collect()] == [("hi", "T")]
    texts = spark.createDataFrame([("en", "A", "x"), ("en", "B", ""), ("hi", "C", "y")], "lang string, title string, text string")
    sinks.append_texts(texts, str(tmp_path / "t"))
    sinks.append_texts(texts, str(tmp_path / "t"), spark.read.parquet(str(tmp_path / "t")))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    assert {r.lang: r.rows for r in sinks.snapshot(texts, str(tmp_path / "s"), "lang").collect()} == {"en": 2, "hi": 1}


def test_nearest_in_blocks(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(60)
    assert sorted(vectors.top_k(df).collect()) == sorted(vectors.top_k(df, block=7).collect())


def test_rectified_net_beats_the_line(spark):
    points = learning.rings(spark).withColumn("samples", F.lit(200).cast("bigint"))
    last = {r.model: r.train_acc for r in learning.histories(points, ("linear", "relu")).where("epoch = 60").collect()}
    assert last["linear"] < 0.75 and last["relu"] > 0.9


def test_windowed_words(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:01:00", "en", "two words")], "ts string, lang string, text string").select(F.to_timestamp("ts").alias("ts"), "lang", "text").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, lang string, text string").parquet(str(tmp_path / "in"))
    q = running.windowed_words(stream).writeStream.format("memory").queryName("words").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.words, r.docs) for r in spark.table("words").collect()] == [(2, 1)]
