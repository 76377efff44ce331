"""The pipeline end to end on nulls, copies, extra columns with clashing names, and nothing."""

import numpy as np
import pytest

import corpus_pipeline
from corpusloom.llm import tokens

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, __loom_key bigint, a string, b int, key string, p double, `x.y` int, keys string"
GOOD = "Sentence number {0} of a plain report tells the reader about harbour {1}, its ships, its winters and the people of street {2}."


def good(i):
    return " ".join(GOOD.format(i * 7 + k, (i * 31 + k * 17) % 997, (i * 13 + k * 5) % 991) for k in range(6))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    leak = " ".join(f"leaked{k}" for k in range(20))
    rows = [(i, good(i), "en", f"host{i % 3}/p") for i in range(60)]
    rows += [(100 + i, "@@ ## $$ 11 22 !! " * 20 + str(i), "en", "host1/p") for i in range(40)]
    rows += [(200, good(0), "en", "host0/p"), (200, good(0), "en", "host0/p"), (201, good(61) + " " + leak, None, None), (None, good(62), None, None), (None, None, None, None), (203, None, "en", "host0/p"), (204, "", "en", "host0/p"), (205, " ".join(good(k) for k in range(70, 900)), "en", "host2/p")]
    d = str(tmp_path_factory.mktemp("edges"))
    spark.createDataFrame([(*r, len(r[1] or ""), 1, "x", 2, "k", 0.5, 3, "q") for r in rows], DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0, 5) for i in range(0, 40)] + [(100 + i, 0, 0, 5) for i in range(30)] + [(None, 1, None, 5), (999, 1, 1, 5)], "doc_id bigint, quality int, toxic int, text int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, leak, 7), (2, None, 7), (None, "x " * 20, 7)], "item_id bigint, text string, doc_id int").write.parquet(f"{d}/benchmark.parquet")
    return d, rows


def test_decisions_and_round_trip(spark, tables):
    d, rows = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = spark.createDataFrame(out.collect(), docs.schema)
        kept[name.split()[0]] = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None)
    texts = {i: t for i, t, *_ in rows if t and i is not None}
    quality = {i for i, _ in kept["quality"]}
    assert {i for i in texts if i < 100} <= quality and not quality & {*range(100, 140), 203, 204} and {200, 201, 205} <= quality
    simhash = [i for i, _ in kept["simhash"]]
    assert len(simhash) == len(set(simhash)) and not ({0, 200} <= set(simhash)) and {201, 205} <= set(simhash)
    assert 201 not in {i for i, _ in kept["benchmark"]} and 205 in {i for i, _ in kept["benchmark"]}
    assert 0 < len(kept["mixing"]) < len(kept["benchmark"])
    out = corpus_pipeline.run(spark, d).collect()
    base = tokens.encoding(tokens.VOCABULARY).n_vocab
    rules = {r.shard: r for r in out if r.rules is not None}
    for r in out:
        if r.rules is None and r.doc_id is not None:
            s = rules[r.shard]
            ids = tokens.decode_ids(tokens.unpack(r.codes, r.width), tokens.unpack_rules(s.rules, s.width), tokens.unpack_lengths(s.lengths), base)
            assert tokens.encoding(tokens.VOCABULARY).decode(np.asarray(ids).tolist()) == texts[r.doc_id]
    assert sorted(r.doc_id for r in out if r.rules is None and r.doc_id is not None) == [i for i, _ in kept["mixing"]]


def test_nothing(spark, tables, tmp_path):
    d, _ = tables
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
