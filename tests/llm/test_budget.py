"""The sample's size is a share of the input, whatever its smallest source."""

import pytest

from corpusloom.llm import mixing


def test_a_tiny_source_leaves_the_others_alone(spark):
    rows = [(i, "w " * (50 + i % 100), f"s{i % 3}") for i in range(3000)] + [(9000, "only ten tokens are in this one source of all", None)]
    got = mixing.decisions(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).toPandas()
    kept = (got.kept * got.n_tokens).sum()
    assert kept == pytest.approx(mixing.BUDGET * got.n_tokens.sum(), rel=0.01)
    assert got[got.source.isna()].kept.tolist() == [1]


def test_excess_is_shared_by_weight(spark):
    units = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), ("d", 4000)], "source string, n_tokens bigint")
    pi = {r.source: r.pi for r in mixing.probabilities(units, {"a": 1.0, "b": 1.0, "c": 1.0, "d": 2.0}, 2110.0).collect()}
    assert pi == pytest.approx({"a": 1.0, "b": 1.0, "c": 2000 / 3 / 1000, "d": 4000 / 3 / 4000})
    assert {r.pi for r in mixing.probabilities(units, None, 1e6).collect()} == {1.0}
