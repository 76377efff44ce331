"""Column functions on hand-checked cases."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import markup, numeric
from corpusloom.functions import text as tx
from corpusloom.operators import counts


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "fn, text, want",
    [
        (tx.clean_text, "école", "école"),
        (tx.strip_comments, "left<!-- unseen\nmark -->right", "leftright"),
        (tx.strip_comments, "a <!-- open", "a <!-- open"),
        (tx.strip_refs, "x<ref name=a/> kept? <ref>y</ref>z", "xz"),
        (tx.clean_text, "Up {{box|x={{in|Q}}|y}} down.", "Up down."),
        (tx.clean_text, "a {{open b", "a"),
        (tx.clean_text, "Cross [[Bridge|an old bridge]] first.", "Cross an old bridge first."),
        (tx.external_links, "At [http://q.org] or [https://r.s/t  here ];", "At  or here;"),
        (tx.wiki_formatting, "=== Rivers ===\nTheir '''long''' course", "Rivers\nTheir long course"),
        (tx.wiki_formatting, "* alpha\n## beta\n: gamma", "alpha\nbeta\ngamma"),
        (tx.clean_text, "a &lt;b&gt;c", "a c"),
        (tx.clean_text, "salt &amp; pepper &lt;5", "salt & pepper <5"),
        (tx.clean_whitespace, "first \t\n\n\n\nnext  line", "first\n\nnext line"),
        (tx.normalize_for_roundtrip, "  hello ", " hello"),
        (tx.pretokens, "Rain; then 7 suns.", ["Rain", ";", "▁then", "▁7", "▁suns", "."]),
        (tx.pretokens, "abc123", ["abc", "123"]),
        (tx.pretokens, "No..way!?", ["No", ".", ".", "way", "!", "?"]),
        (tx.pretokens, "  \n", []),
        (tx.pretokens, "விலை42.", ["விலை", "42", "."]),
        (tx.pretokens, "  hello", ["▁hello"]),
        (tx.faithful_units, "a-b c", 4),
        (tx.codepoints, "a\U0001f600b", ["a", "\U0001f600", "b"]),
        (markup.slug, "Été à Paris", "ete_a_paris"),
        (markup.slug, "!!!", "article"),
        (tx.parse_spec, "en=3.0, te=1.5", {"en": 3.0, "te": 1.5}),
        (tx.clean_text, None, None),
    ],
)
def test_text(spark, fn, text, want):
    assert one(spark, text, fn) == want


def test_merged_symbols(spark):
    df = spark.createDataFrame([(["a", "a", "a", "b"],)], "s array<string>")
    assert df.select(tx.merged_symbols(F.col("s"), F.lit("a"), F.lit("a"))).first()[0] == ["aa", "a", "b"]


def test_markdown():
    page = "<head><title>x</title></head><h2>Head</h2><p>One <b>bold</b> <a href='/w'>link</a></p><ul><li>a<li>b</ul><script>no</script>"
    assert markup.to_markdown(page) == "## Head\n\n\nOne **bold** [link](https://en.wikipedia.org/w)\n\n\n- a\n- b\n"


def test_draws(spark):
    got = [r[0] for r in spark.range(5).select(numeric.mulberry(1, F.col("id"))).collect()]
    assert got == pytest.approx([0.6270739405881613, 0.002735721180215478, 0.5274470399599522, 0.9810509674716741, 0.9683778982143849])


def test_pretokens_keep_one_mark_for_any_white_space(spark):
    text = "  a \tb ▁c\n\n1２x —  é́ \r\n"
    got = spark.createDataFrame([(text,), (None,), ("",), (" \n",)], "text string")
    rows = [r.t for r in got.select(tx.pretokens(F.col("text")).alias("t")).collect()]
    assert rows == [["▁a", "▁b", "▁▁", "c", "▁1２", "x", "▁—", "▁é́"], None, [], []]
    # no function of arrays is run on each token where words are counted
    plan = counts.language_words(got.withColumn("lang", F.lit("en")))._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan


def test_counts_make_no_lists_of_matches(spark):
    from corpusloom.plans import curation_plans

    d = "/root/testdata/sf0.001"
    assert [r.n for r in spark.createDataFrame([("aÉ1β𝒳",), ("",), (None,)], "t string").select(tx.left_of(F.col("t"), "[^a-z]").alias("n")).collect()] == [1, 0, None]
    for query in (curation_plans.script_id, curation_plans.quality_features):
        plan = query(spark, d)._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_count" not in plan.lower() and "regexp_extract_all(text" not in plan.lower()


def test_batches_of_texts_are_bounded(spark):
    from corpusloom.plans import text_plans

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    text_plans.page_markdown(spark, "/root/testdata/sf0.001")
    assert spark.conf.get(key) == "8m"


def test_entities_cut_short_are_decoded(spark):
    # as html.unescape does, with which the reference cleans
    assert one(spark, "and&amp<b>so &ampT", tx.clean_text) == "and&so &T"
