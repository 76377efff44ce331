"""Vectors of several dimensions, ties, repeated ids: against all pairs."""

import numpy as np

from corpusloom.llm import common, embedding_dedup


def test_every_dimension_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    rows, want, start = [], set(), 0
    for d, n in ((24, 300), (7, 90), (3, 5), (1, 2)):
        x = rng.normal(size=(n, d))
        x = np.concatenate([x, x[: n // 3] + rng.normal(size=(n // 3, d)) * 0.08, x[: n // 6], -x[:2]])
        ids = np.arange(start, start + len(x))
        start += len(x)
        rows += [(int(i), v.tolist()) for i, v in zip(ids, x)]
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        a, b = np.nonzero(np.triu(u @ u.T >= 0.95, 1))
        node, comp = common.union_find(ids[a], ids[b]) if len(a) else ([], [])
        want |= {(int(c), int(k)) for k, c in zip(node, comp) if k != c}
    df = spark.createDataFrame([*rows, rows[0], rows[5], (None, [1.0] * 24), (99_999, [0.0] * 7)], "vec_id bigint, embedding array<double>")
    for params in ({}, {"cell": 20, "block": 16}, {"cell": 20, "slack": 100.0, "block": 8}, {"cell": 10, "max_cells": 2, "split": 2}, {"cell": 10, "max_cells": 2, "split": 2, "slack": 100.0}):
        got = {(r.rep_id, r.vec_id) for r in embedding_dedup.near_duplicates(df, **params).collect()}
        assert got == want if params.get("cell") is None or "slack" in params else got <= want and len(got) >= 0.9 * len(want)


def test_a_representative_of_equal_vectors_is_the_least_id(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0 * (i % 2)]) for i in (9, 8, 7, 6, 5)] * 2, "vec_id bigint, embedding array<double>")
    assert sorted(tuple(r) for r in embedding_dedup.near_duplicates(df).collect()) == [(5, 7), (5, 9), (6, 8)]
