"""Decontamination means the same with a broadcast and with a joined benchmark."""

import random

import duckdb
import pytest

from corpusloom.llm import decontaminate

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def words(rng, n):
    return " ".join(f"w{rng.randrange(30)}" for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(0)
    items = [(1, words(rng, 20)), (1, words(rng, 25)), (2, words(rng, 7)), (3, words(rng, 5)), (4, words(rng, 12)), (5, words(rng, 3)), (6, None), (None, words(rng, 20)), (7, words(rng, 13)), (1, None)]
    items.append((1, items[0][1]))
    texts = [words(rng, rng.randrange(60)) for _ in range(200)]
    for i in range(0, 200, 4):
        texts[i] += f" {rng.choice([x for x in items if x[1]])[1]} {words(rng, 5)}"
    rows = [(i if i % 9 else None, x) for i, x in enumerate(texts)] + [(3, texts[0]), (3, texts[1]), (5, None), (8, texts[8]), (8, texts[8])]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS)


def test_spans_are_those_of_the_sql(tables):
    docs, items = tables
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("benchmark", items.toPandas())
    want = {tuple(r) for r in con.execute(decontaminate.ORACLES["op7_decontaminate"]).fetchall()}
    for limit in (0, decontaminate.BROADCAST_WORDS):
        got = [tuple(r) for r in decontaminate.contaminated_spans(docs, items, broadcast_words=limit).collect()]
        assert len(got) == len(set(got)) and set(got) == want and {f[1] for f in want} >= {1, 2, 3, 4}


def test_rows_are_judged_by_their_text(spark, tables):
    docs, items = tables
    ways = [sorted(map(str, decontaminate.clean(docs, items, broadcast_words=limit).collect())) for limit in (0, decontaminate.BROADCAST_WORDS)]
    assert ways[0] == ways[1] and len(ways[0]) < docs.count()


@pytest.mark.parametrize("limit", [0, decontaminate.BROADCAST_WORDS])
def test_ids_decide_nothing(spark, limit):
    one, two = (" ".join(f"{c}{k}" for k in range(15)) for c in "ab")
    items = spark.createDataFrame([(1, one), (1, two), (2, "just five words in here")], ITEMS)
    rows = [(1, "x " + one), (2, two), (3, "calm"), (None, one), (4, one), (4, "clean text of the same id"), (5, "Just five words in here!"), (6, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = decontaminate.contaminated_spans(docs, items, broadcast_words=limit).collect()
    assert {(r.doc_id, r.item_id, r.doc_word, r.n_words) for r in got} == {(1, 1, 1, 15), (2, 1, 0, 15), (4, 1, 0, 15), (5, 2, 0, 5)}
    assert sorted((r.doc_id, r.text) for r in decontaminate.clean(docs, items, broadcast_words=limit).where("text IS NOT NULL").collect()) == [(3, "calm"), (4, "clean text of the same id")]
