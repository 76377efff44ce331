"""What copies, frequency and length must not change."""

import random

from corpusloom.llm import toxicity

SCHEMA = "doc_id bigint, text string"


def test_copies_do_not_make_a_misspelling_ordinary(spark):
    rows = [(i, f"what a moronn he is, they all say so at the end of a text of some words, copy {i}") for i in range(40)]
    rows += [(100, "you moron, go away"), (101, "never seen you scumbagg before")]
    got = {r.doc_id for r in toxicity.toxic(spark.createDataFrame(rows + [(102, rows[41][1])], SCHEMA)).collect()}
    assert got == {*range(40), 100, 101, 102}


def test_a_form_of_many_calm_contexts_is_ordinary(spark):
    rows = [(i, f"on day {i} the moronn of village number {i * 7} was seen by {i * 3} people") for i in range(40)]
    assert toxicity.toxic(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_a_passage_in_a_long_text(spark):
    rng = random.Random(6)
    plain = [f"w{rng.randrange(400)}" for _ in range(40_000)]
    rows = []
    for i in range(200):
        text = plain[i * 150 : i * 150 + 100]
        if i % 4 == 0:
            text[10], text[50], text[70] = "zorgle", "zorgle", "blarfen"
        rows.append((i, " ".join(text)))
    abuse = ["zorgle", "blarfen", "zorgle", "blarfen", "zorgle"]
    rows.append((500, " ".join(plain[:20_000] + abuse + plain[20_000:])))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id bigint, toxic int")
    assert 500 in {r.doc_id for r in toxicity.toxic(spark.createDataFrame(rows, SCHEMA), labels).collect()}
