"""What is served: tokenized requests, statistics, reports, artifact sets, page files, stored answers."""

import json
import os
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import numeric as nm
from corpusloom.functions import text as tx
from corpusloom.operators import bpe, counts, learning, ranks
from corpusloom.sources import files, sinks, static

ROWS = [(1, "en", "the cat and the hat, the mat"), (2, "en", "a cat sat"), (3, "de", "die katze und der hut"), (4, "fr", "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id bigint, lang string, text string")


@pytest.fixture(scope="module")
def trained(spark, docs):
    words = counts.word_frequencies(docs)
    base = counts.base_vocabulary(words)
    merges = bpe.train(words, 12, known=tuple(counts.SPECIALS))
    return base, merges, bpe.Tokenizer.of(base, merges)


def test_a_request_gets_all_forms(docs, trained):
    tokenizer = trained[2]
    for r in bpe.tokenized(docs, tokenizer).collect():
        assert ["".join(p) for p in r.pieces] == r.pretokens and [x for p in r.pieces for x in p] == r.tokens
        assert r.ids == [tokenizer.vocab[t] for t in r.tokens] and r.decoded == r.text.rstrip()
    odd = docs.sparkSession.createDataFrame([("xyz cat",), (None,), ("",)], "text string")
    got = {r.text: r for r in bpe.tokenized(odd, tokenizer).collect()}
    assert got[None].ids is None and got[""].ids == [] and tokenizer.vocab["<unk>"] in got["xyz cat"].ids
    with pytest.raises(KeyError):
        bpe.Tokenizer(tokenizer.ranks, {"a": 0}).ids("b")


def test_statistics_and_report(docs, trained):
    tokenizer = trained[2]
    got = {r.language: r for r in bpe.served_statistics(docs, tokenizer, ("en", "de", "ta")).collect()}
    for lang in ("en", "de"):
        texts = [t for _, c, t in ROWS if c == lang]
        tokens = sum(len(r.ids) for r in bpe.encode(docs.where(F.col("lang") == lang), tokenizer).collect())
        units = sum(len([w for w in __import__("re").findall(r"\w+|[^\w\s]", t)]) for t in texts)
        assert (got[lang].total_tokens, got[lang].total_words, got[lang].ratio) == (tokens, units, tokens / units)
    assert (got["ta"].total_tokens, got["ta"].total_words, got["ta"].ratio) == (0, 0, 0.0)
    report = bpe.full_report(bpe.served_statistics(docs, tokenizer, ("en", "de", "ta")), 99).first()
    a, b = sorted((got["en"].ratio, got["de"].ratio))
    assert (report.vocab_size, report.smallest_ratio, report.largest_ratio, report.difference) == (99, a, b, b - a)
    assert [x.language for x in report.languages] == ["de", "en", "ta"] and float(report.assignment_score) == pytest.approx(1000 / (b - a))
    same = bpe.full_report(bpe.served_statistics(docs.where("lang = 'en'"), tokenizer), 99).first()
    assert same.difference == 0 and same.assignment_score == "Infinity"
    with pytest.raises(ValueError):
        bpe.served_statistics(docs.where("lang = 'fr'"), tokenizer)


def test_gate_and_summary(docs, trained):
    reports = bpe.evaluate(docs.where("text <> ''"), trained[2])
    fertility = {r.language: r.fertility for r in reports.collect()}
    for most in (0.5, 99.0):
        assert [tuple(r) for r in bpe.language_gate(reports, "en", most).collect()] == [("en", fertility["en"], most, most > 1)]
    assert bpe.language_gate(reports, "hi").count() == 0
    lines = {r.language: r.line for r in bpe.summary(reports).collect()}
    assert lines["en"].split()[:3] == ["en", "2", "10"] and "OK" in lines["en"]


def test_artifact_set(spark, tmp_path, docs, trained):
    folder = str(tmp_path / "artifacts")
    base, merges, tokenizer = trained
    with pytest.raises(files.Missing):
        files.artifact(spark, f"{folder}/vocab.json")
    assert files.config(spark, folder) == {} and not any(r.present for r in files.health(spark, folder).collect())
    vocab = spark.createDataFrame(list(tokenizer.vocab.items()), "token string, id int")
    stats = spark.createDataFrame([("en", 2, 9, 0.123456), ("de", 1, 5, 2.0)], "language string, num_documents int, raw_word_count int, weight double")
    config = sinks.training_config(stats, len(tokenizer.vocab), 100, 12, 1.23456, boosts={"en": 3.0})
    assert config["training_seconds"] == 1.23 and config["language_stats"]["en"]["weight"] == 0.1235 and config["languages"] == ["de", "en"]
    sinks.write_artifacts(vocab, merges, config, bpe.evaluate(docs, tokenizer), folder)
    assert all(r.present for r in files.health(spark, folder).collect()) and files.config(spark, folder) == config
    again = bpe.Tokenizer({(r.left, r.right): r.rank for r in files.merges(spark, f"{folder}/merges.json").collect()}, {r.token: r.id for r in files.vocabulary(spark, f"{folder}/vocab.json").collect()})
    assert again == tokenizer
    whole = json.loads(files.artifact(spark, f"{folder}/tokenizer.json").first().content)
    assert whole["model"]["vocab"] == tokenizer.vocab and len(whole["model"]["merges"]) == len(tokenizer.ranks)
    first = files.artifact(spark, f"{folder}/eval_report.json")
    assert files.artifact(spark, f"{folder}/eval_report.json") is first
    os.utime(f"{folder}/eval_report.json", (1, 1))
    assert files.artifact(spark, f"{folder}/eval_report.json") is not first


def test_page_files(spark, tmp_path):
    pages = spark.createDataFrame([("en", "Río Grande", "https://x.org/r", "<h1>Río</h1><p>It flows.</p>")], "lang string, title string, url string, html string")
    sinks.write_page_files(pages, str(tmp_path / "pages"))
    row = spark.read.parquet(str(tmp_path / "pages")).first()
    meta = json.loads(row.metadata)
    assert row.slug == "rio_grande" and row.markdown == row.text == "# Río\n\n\nIt flows.\n"
    assert (meta["lang"], meta["source_url"], meta["chars"], meta["faithful_units"]) == ("en", "https://x.org/r", len(row.markdown), 5)


def test_stored_answers(spark):
    body = json.dumps({"query": {"pages": {"7": {"extract": "Plain text.", "langlinks": [{"lang": "hi", "*": "H"}, {"lang": "xx", "*": "X"}]}}}})
    payloads = spark.createDataFrame([("en", "A", body), ("en", "B", json.dumps({"query": {"pages": {"-1": {}}}})), ("en", "C", "{}")], "lang string, title string, body string")
    assert {(r.title, r.extract) for r in files.page_extracts(payloads).collect()} == {("A", "Plain text."), ("B", ""), ("C", "")}
    links = files.language_links(payloads, ("hi", "te")).select(F.lit("A").alias("en_title"), "lang", "title")
    titles = spark.createDataFrame([("A",), ("B",)], "en_title string")
    assert {tuple(r) for r in files.linked_titles(titles, links, ("hi", "te")).collect()} == {("A", "hi", "H"), ("A", "te", None), ("B", "hi", None), ("B", "te", None)}


def test_folders_of_languages(spark, tmp_path):
    for lang, texts in (("en", ["one text", "﻿two"]), ("ta", [" \n"])):
        (tmp_path / lang).mkdir()
        for i, t in enumerate(texts):
            (tmp_path / lang / f"{i}.txt").write_text(t)
    with pytest.warns(UserWarning, match="ta, te"):
        texts = files.corpus(spark, str(tmp_path), ["en", "ta", "te"])
    assert {tuple(r) for r in files.document_counts(texts, ["en", "ta", "te"]).collect()} == {("en", 2), ("ta", 0), ("te", 0)}
    with warnings.catch_warnings(), pytest.raises(ValueError):
        warnings.simplefilter("error")
        files.corpus(spark, str(tmp_path), ["ta"])


def test_replication_is_multiplication(spark, docs):
    copies = {"en": 2, "de": 3}
    many = docs.where("lang <> 'fr'").unionByName(docs.where("lang <> 'fr'")).unionByName(docs.where("lang = 'de'"))
    assert sorted(counts.replicated_frequencies(docs, copies).collect()) == sorted(counts.word_frequencies(many).collect())
    assert counts.replicated_frequencies(docs, {}).count() == 0


def test_specials_are_a_parameter(docs):
    got = {r.token: r.id for r in counts.base_vocabulary(counts.word_frequencies(docs), {"[UNK]": 0}).collect()}
    assert got["[UNK]"] == 0 and min(i for t, i in got.items() if t != "[UNK]") == 1 and len(set(got.values())) == len(got)


def test_positions_are_a_window_s(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g) if g < 5 else None, int(v), i) for i, (g, v) in enumerate(zip(rng.integers(0, 6, 500) * rng.integers(0, 2, 500), rng.integers(0, 20, 500)))]
    df = spark.createDataFrame(rows, "g int, v int, id int")
    from pyspark.sql import Window

    w = Window.partitionBy("g").orderBy("v", "id")
    want = {tuple(r) for r in df.select("id", F.row_number().over(w) - 1, F.count("*").over(Window.partitionBy("g")), F.ntile(7).over(w)).collect()}
    got = ranks.positions(df, "g", ["v", "id"], parts=9)
    assert {tuple(r) for r in got.select("id", "position", "size", ranks.ntile(F.col("position"), F.col("size"), 7)).collect()} == want
    assert ranks.positions(df.limit(0), "g", ["v", "id"]).count() == 0


def test_joins_by_frequency_lose_nothing(spark):
    rows = spark.createDataFrame([(f"w{i % 7 if i % 3 else 0}", i) for i in range(300)] + [("rare", -1)], "w string, i int")
    model = rows.groupBy("w").agg(F.count("*").alias("c"))
    one, two = (sorted(map(str, ranks.joined_by_frequency(rows, model, "w", "c", limit, 2).select("w", "i", "c").collect())) for limit in (0, 100))
    assert one == two and len(one) == 301


def test_shown_numbers(spark):
    shown = spark.range(1).select(nm.fixed(F.lit(1.23456), 4), nm.thousands(F.lit(1234567)), nm.short(F.lit(2.50)), nm.short(F.lit(3.0)), nm.percent(F.lit(0.125)), nm.predicted(F.lit(0.5)), nm.predicted(F.lit(0.5), strict=True))
    assert list(shown.first()) == ["1.2346", "1,234,567", "2.5", "3", "12.5%", 1, 0]
    names = spark.createDataFrame([("ta",), ("zz",)], "c string").select(static.display_name(F.col("c")))
    assert [r[0] for r in names.collect()] == ["Tamil", "zz"]


def test_rings_are_the_sequence_s(spark):
    u = learning.draws(1, 700)
    assert u[:50].tolist() == [r[0] for r in spark.range(50).select(nm.mulberry(1, F.col("id"))).orderBy("id").collect()]
    pts = {r.id: r for r in learning.rings(spark, 40, seed=1).collect()}
    order = list(range(40))
    for k, i in enumerate(range(39, 0, -1)):
        j = int(u[120 + k] * (i + 1))
        order[i], order[j] = order[j], order[i]
    assert [pts[x].pos for x in order] == list(range(40)) and sum(p.label for p in pts.values()) == 20
    r = 0.5 + 0.08 * np.sqrt(-2 * np.log(u[9])) * np.cos(2 * np.pi * u[10])
    assert pts[3].x == pytest.approx(r * np.cos(2 * np.pi * u[11]))


def test_nets_tell_rings_and_tokens(spark):
    points = learning.rings(spark)
    at = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (0.0, -1.0)], "x double, y double")
    got = {(r.x, r.y): r.relu for r in learning.predictions(points, at, ("relu", "linear"), epochs=150).collect()}
    assert got[0.0, 0.0] < 0.5 < min(got[1.0, 0.0], got[0.0, -1.0])
    pairs = spark.createDataFrame([(i, "abc"[i % 3], "bca"[i % 3]) for i in range(120)], "pos bigint, a string, b string")
    rows = learning.next_token_net(pairs, dim=4, epochs=60, rate=0.05).collect()
    losses = [r.loss for r in rows if r.epoch]
    assert len(losses) == 60 and losses[-1] < 0.2 < losses[0] and [r.accuracy for r in rows if r.epoch][-1] == 1
    assert {r.token: len(r.vector) for r in rows if r.token} == {"a": 4, "b": 4, "c": 4}
    assert tx.MARK == "▁"


def test_queries_against_all_vectors(spark):
    from corpusloom.operators import vectors

    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 6))
    x[40] = x[10]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, [1.0] * 6), (200, None), (201, [1.0, None]), (300, [1.0, 2.0])], "vec_id bigint, embedding array<double>")
    s = np.round(x @ x.T / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(x, axis=1) + 1e-8), 9)
    np.fill_diagonal(s, -9)
    want = {(i, r + 1, int(j)) for i in range(90) for r, j in enumerate(np.lexsort((np.arange(90), -s[i]))[:3])}
    for block in (7, 4096):
        assert {(r.query_id, r.rank, r.vec_id) for r in vectors.top_k(df, block=block).collect()} == want
        some = {(r.query_id, r.rank, r.vec_id) for r in vectors.top_k(df, block=block, queries=F.col("vec_id") % 50 == 0).collect()}
        assert some == {x for x in want if x[0] % 50 == 0}
