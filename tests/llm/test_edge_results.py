"""What the operators make of nulls, empty and long texts, ties, repeated rows, and columns named like their own."""

import pytest

from corpusloom.llm import decontaminate, embedding_dedup, licenses, mixing, pii, quality, secrets, simhash_dedup, tokens, toxicity

#: Columns of the operators' own tables, and such as a caller might have.
NAMES = ["__loom_key", "__loom_id", "__loom_row", "__loom_unit", "__loom_md5", "__loom_site", "__loom_z", "__loom_host", "a", "b", "key", "keys", "fp", "at", "item", "hits", "words", "uid", "p", "pi", "h", "part", "z", "y", "n", "w", "t", "f0", "comp", "node", "x.y", "count"]
TOKEN = "ghp_" + "aB3dE6gH9jK2mN5pQ8sT1vW4yZ7bC0eF3hI6"
LONG = "plain " * 50_000
TEXT = f"{LONG}mail ann@example.org, token {TOKEN}. Released under the MIT License. You are an idiot."


def table(spark, rows, names=NAMES):
    schema = "doc_id bigint, text string, lang string, source string, " + ", ".join(f"`{c}` {'string' if i % 2 else 'int'}" for i, c in enumerate(names))
    extra = tuple("x" if i % 2 else 7 for i in range(len(names)))
    return spark.createDataFrame([(*r, "en", "s", *extra) for r in rows], schema)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, [(1, TEXT), (1, TEXT), (None, TEXT), (2, None), (3, ""), (None, None), (4, " \n")])


def found(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_scans_report_every_row(docs):
    who = [(1,), (1,), (None,)]
    n = len(LONG)
    assert found(secrets.secrets(docs), "doc_id", "kind", "secret") == [(*w, "github_token", TOKEN) for w in who]
    assert found(pii.identifiers(docs), "doc_id", "kind", "value", "start", "disguised") == [(*w, "email", "ann@example.org", n + 5, False) for w in who]
    assert found(licenses.licenses(docs), "doc_id", "license") == [(*w, "MIT") for w in who]
    assert [x[0] for x in found(toxicity.toxic(docs), "doc_id")] == [1, 1, None]
    for scan in (secrets.secrets, pii.identifiers, licenses.licenses, toxicity.toxic, tokens.encoded, simhash_dedup.near_duplicates, mixing.decisions):
        assert scan(docs.limit(0)).count() == 0


def test_tokens_of_every_row(docs):
    rows = [r for r in tokens.encoded(docs).collect() if r.rules is None]
    n = len(tokens.encoding(tokens.VOCABULARY).encode(TEXT))
    assert found_rows(rows) == sorted([(1, n), (1, n), (None, n), (2, None), (3, 0), (None, None), (4, len(tokens.encoding(tokens.VOCABULARY).encode(" \n")))], key=str)
    assert all((r.codes is None) == (r.n_tokens is None) for r in rows)


def found_rows(rows):
    return sorted(((r.doc_id, r.n_tokens) for r in rows), key=str)


def test_stages_with_columns_of_their_own_names(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0, 5, "q")], "doc_id bigint, quality int, toxic int, y int, __loom_id string")
    bench = spark.createDataFrame([(1, TEXT[-120:], 5, "q")], "item_id bigint, text string, doc_id int, fp string")
    columns = docs.columns
    near = simhash_dedup.keep_one(docs)
    assert near.columns == columns and found(near, "doc_id") == [(1,), (2,), (3,), (4,), (None,), (None,)]
    for limit in (0, decontaminate.BROADCAST_WORDS):
        clean = decontaminate.clean(docs, bench, broadcast_words=limit)
        assert clean.columns == columns and found(clean, "doc_id") == [(2,), (3,), (4,), (None,)]
        assert found(decontaminate.contaminated_spans(docs, bench, broadcast_words=limit), "doc_id", "item_id") == [(1, 1)]
    good = quality.accepted(docs, labels)
    assert good.columns == columns and found(good, "doc_id") == [(1,), (1,), (None,)]
    assert found(quality.scores(docs, labels), "doc_id", "posterior")[0][1] > 0.5
    mixed = mixing.sample(docs, tokens=1e9)
    assert mixed.columns == columns and len(found(mixed, "doc_id")) == docs.count()
    # of a document that counts once, all rows or none
    assert found(mixing.decisions(docs, tokens=1e9), "doc_id", "kept") == [(1, 1), (2, 1), (3, 1), (4, 1), (None, 1)]


def test_ties(spark):
    same = table(spark, [(i, "one text of some words that all of these have in common") for i in (5, 4, 9, 7)])
    assert found(simhash_dedup.near_duplicates(same), "rep_id", "doc_id") == [(4, 5), (4, 7), (4, 9)]
    assert found(simhash_dedup.keep_one(same), "doc_id") == [(4,)]
    picks = [found(mixing.decisions(x, tokens=24.0), "doc_id", "kept") for x in (same, same.repartition(3))]
    assert picks[0] == picks[1] and sum(k for _, k in picks[0]) == 2
    scores = found(quality.scores(same, spark.createDataFrame([(4, 1), (5, 0)], "doc_id bigint, quality int")), "posterior")
    assert len(set(scores)) == 1
    # of terms equally near the heavier, then the first by name
    one = toxicity.toxic(table(spark, [(1, "zarbln")]), lexicon={"zarblan": 0.9, "zarblen": 1.0, "zarblin": 1.0}).collect()
    assert [(h.term, h.edits) for h in one[0].hits] == [("zarblen", 1)]
    vectors = spark.createDataFrame([(i, [1.0, 0.0, 0.0]) for i in (3, 2)] + [(2, [0.0, 1.0, 0.0])], "vec_id bigint, embedding array<double>")
    assert found(embedding_dedup.near_duplicates(vectors), "rep_id", "vec_id") == []
