"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import decontaminate, embedding_dedup, licenses, mixing, pii, quality, secrets, simhash_dedup, tokens, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = DOCS + ", host string, p double, n bigint, `a.b` int, count int, z double"
GOOD = "The quick assembly of plain sentences gives a reader enough to judge the writing by, number {}."
LONG = " ".join(f"word{i}" for i in range(60_000))


def rows():
    texts = [None, "", " \n\t", "!!!", "x" * 200_000, LONG, *[GOOD.format(i) for i in range(6)], GOOD.format(0), GOOD.format(0)]
    out = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    return [*out, out[8], (None, GOOD.format(3), None, None, 1), (None, None, None, None, None), (30, "null source idiot moron scum", None, None, 5)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "h", 0.5, 1, 2, 3, 0.1) for r in rows()], CLASH)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASH)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(4, 12)] + [(None, 1, 1), (5, None, None), (5, 0, 0), (999, 1, 1)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(500, 540))), (2, None), (None, "a b c"), (3, ""), (4, "short")], "item_id bigint, text string")


def scans(labels, benchmark):
    return {
        "secrets": secrets.secrets, "licenses": licenses.licenses, "pii": pii.identifiers, "tokens": tokens.encoded,
        "toxic": lambda d: toxicity.toxic(d, labels), "spans": lambda d: decontaminate.contaminated_spans(d, benchmark),
        "near": simhash_dedup.near_duplicates, "mix": mixing.decisions, "quality": lambda d: quality.scores(d, labels),
    }


@pytest.mark.parametrize("name", ["secrets", "licenses", "pii", "tokens", "toxic", "spans", "near", "mix", "quality"])
def test_queries_take_anything(docs, empty, labels, benchmark, name):
    run = scans(labels, benchmark)[name]
    assert run(empty).count() == 0
    got = run(docs).collect()
    if name == "spans":
        assert [(r.doc_id, r.item_id, r.n_words) for r in got] == [(5, 1, 40)]
    if name == "near":
        pairs = {(r.rep_id, r.doc_id) for r in got}
        assert {(6, 12), (6, 13)} <= pairs and not {0, 1, 2, 3, 4, 5} & {x for p in pairs for x in p}
    if name == "tokens":
        assert len([r for r in got if r.rules is None]) == len(rows())
    if name == "quality":
        assert len(got) == len(rows()) and all(r.posterior == 0 for r in got if r.doc_id in (0, 1, 2, 3))
    if name == "mix":
        assert len(got) == len({r[0] for r in rows()})
    if name == "toxic":
        assert [r.doc_id for r in got] == [30]


def test_stages_keep_the_columns(docs, empty, labels, benchmark):
    stages = {
        "quality": lambda d: quality.accepted(d, labels), "near": simhash_dedup.keep_one, "clean": lambda d: decontaminate.clean(d, benchmark), "mix": mixing.sample,
    }
    for run in stages.values():
        assert run(docs).columns == docs.columns and run(docs).dtypes == docs.dtypes
        assert run(empty).count() == 0
        run(docs).collect()
    kept = [r.doc_id for r in stages["near"](docs).collect()]
    assert sorted(x for x in kept if x is not None)[:7] == [0, 1, 2, 3, 4, 5, 6] and not {12, 13} & set(kept) and kept.count(None) == 2
    assert len(kept) == len(set(kept)) + 1
    assert {r.doc_id for r in stages["clean"](docs).collect()} == {r[0] for r in rows()} - {5}


def test_empty_side_tables(spark, docs, labels, benchmark):
    none, nothing = labels.limit(0), benchmark.limit(0)
    assert decontaminate.contaminated_spans(docs, nothing).count() == 0
    assert decontaminate.clean(docs, nothing).count() == docs.count()
    assert quality.accepted(docs, none).where("text = '' OR text IS NULL").count() == 0
    assert [r.doc_id for r in toxicity.toxic(docs, none).collect()] == [30]


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (None, [1.0, 0.0]), (5, None), (6, []), (7, [0.0, 0.0]), (8, [float("nan"), 1.0]), (9, [1.0, None]), (10, [1.0, 0.0, 0.0])]
    vectors = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<double>, d int, cell string")
    assert [tuple(r) for r in embedding_dedup.near_duplicates(vectors).collect()] == [(1, 2)]
    assert embedding_dedup.near_duplicates(vectors.limit(0)).count() == 0


def test_pipeline_order():
    assert [n.split()[0] for n, _ in corpus_pipeline.STAGES] == ["quality", "simhash", "benchmark", "mixing", "token-id"]


def test_pipeline_is_its_stages(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, d)
        docs.write.parquet(str(tmp_path / str(len(list(tmp_path.iterdir())))))
        docs = spark.read.parquet(str(sorted(tmp_path.iterdir(), key=lambda p: p.stat().st_mtime)[-1]))
        assert docs.columns == before.columns and docs.join(before, "doc_id", "left_anti").count() == 0
    ids = lambda df: sorted(r.doc_id for r in df.where("rules IS NULL").select("doc_id").collect())
    out = corpus_pipeline.run(spark, d)
    assert ids(out) == sorted(r.doc_id for r in docs.select(F.col("doc_id")).collect())
