"""Rows of one id in near-dedup, and the quality posteriors by plain arithmetic."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import mixing, quality, simhash_dedup
from corpusloom.llm.common import without

DOCS = "doc_id bigint, text string, lang string, source string"
TEXTS = [" ".join(f"{c}{k}" for k in range(60)) for c in "abcd"]


def test_no_text_goes_for_another_s_sake(spark):
    rows = [(1, TEXTS[0]), (2, TEXTS[1]), (2, TEXTS[0]), (2, TEXTS[1]), (3, TEXTS[2]), (3, None), (3, None), (None, TEXTS[3]), (None, TEXTS[3]), (4, TEXTS[2] + " more"), (5, ""), (5, " ")]
    docs = spark.createDataFrame([(*r, "en", "s") for r in rows], DOCS)
    got = sorted(((r.doc_id, r.text) for r in simhash_dedup.keep_one(docs).collect()), key=str)
    texts = [t for i, t in got if i is not None and t and t.strip()]
    # one row of each content: a, b, c (or c with one more word), whatever its id
    assert sorted(t.split()[0] for t in texts) == ["a0", "b0", "c0"]
    assert [i for i, _ in got].count(None) == 2 and (3, None) in got and (5, "") in got and (5, " ") in got


def test_left_out_ids_in_both_ways(spark):
    docs = spark.createDataFrame([(i % 50 if i % 7 else None, "t", "en", "s") for i in range(300)], DOCS)
    ids = spark.createDataFrame([(i,) for i in range(0, 60, 3)], "doc_id bigint")
    one, two = (sorted(map(str, without(docs, ids, broadcast_rows=n).collect())) for n in (0, 100))
    assert one == two and 0 < len(one) < 300


def test_sample_in_both_ways(spark):
    docs = spark.createDataFrame([(i if i % 90 else None, "w " * (1 + i * 37 % 90), "en", f"s{i % 3}") for i in range(900)], DOCS)
    one, two = (sorted(map(str, mixing.sample(docs, broadcast_ids=n).collect())) for n in (0, 10_000))
    assert one == two and 0 < len(one) < 900


def strength(groups):
    """groups: (values, prior mean). Between-group spread beyond what the groups' sizes explain."""
    n, k = sum(len(v) for v, _ in groups), len(groups)
    if k < 2 or n <= k:
        return 10.0
    means = [sum(v) / len(v) for v, _ in groups]
    within = sum(max(0.0, sum(x * x for x in v) - len(v) * m * m) for (v, _), m in zip(groups, means)) / (n - k)
    between = sum(len(v) * (m - p) ** 2 for (v, p), m in zip(groups, means))
    spread = (between - (k - 1) * within) / max(n - sum(len(v) ** 2 for v, _ in groups) / n, 1e-9)
    mu = min(max(sum(p for _, p in groups) / k, 1e-6), 1 - 1e-6)
    return min(1e6, max(1.0, mu * (1 - mu) / max(spread, 1e-12) - 1))


def test_posteriors_by_plain_arithmetic(spark):
    rng = random.Random(3)
    rows = [(h, p, rng.gauss({"a": 2, "b": -2, "c": 0}[h], 2)) for h in "abc" for p in "xyz" for _ in range(rng.choice([1, 3, 40]))]
    sites, mu = quality.site_posteriors(spark.createDataFrame([*rows, ("a", "x", None)], "host string, path string, z double"))
    p = [(h, q, 1 / (1 + math.exp(-z))) for h, q, z in rows]
    mean = sum(x for *_, x in p) / len(p)
    hosts, paths = defaultdict(list), defaultdict(list)
    for h, q, x in p:
        hosts[h].append(x)
        paths[h, q].append(x)
    k = strength([(v, mean) for v in hosts.values()])
    post = {h: (sum(v) + k * mean) / (len(v) + k) for h, v in hosts.items()}
    k = strength([(v, post[h]) for (h, _), v in paths.items()])
    want = {(h, q): (len(v), post[h], (sum(v) + k * post[h]) / (len(v) + k)) for (h, q), v in paths.items()}
    got = {(r.host, r.path): (r.n, r.host_post, r.path_post) for r in sites.collect()}
    assert mu == pytest.approx(mean) and got.keys() == want.keys()
    for s, v in want.items():
        assert got[s] == pytest.approx(v)


def test_scores_by_plain_arithmetic(spark):
    """The query's rows: the evidence of the fitted model, moved by the site."""
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = quality.scores(docs, labels).collect()
    model = quality.train(docs, labels)
    text = {r.doc_id: r.text for r in docs.collect()}
    import numpy as np
    import pyarrow as pa

    mu = np.mean([r.p_doc for r in rows if r.p_doc > 0])
    for r in rows:
        x = quality.features(pa.array([text[r.doc_id]]))[0]
        if np.isnan(x).any():
            assert r.p_doc == r.posterior == 0
            continue
        z = float(model.logit(x[None])[0])
        assert r.p_doc == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-6)
        z += math.log(r.path_post / (1 - r.path_post)) - math.log(mu / (1 - mu))
        assert r.posterior == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-4)


def test_an_id_is_learned_from_once(spark):
    rows = [(1, TEXTS[0], "en", "s")] * 500 + [(i, TEXTS[i % 4], "en", "s") for i in range(2, 9)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)], "doc_id bigint, quality int")
    once = quality.train(spark.createDataFrame(rows[499:], DOCS), labels)
    many = quality.train(spark.createDataFrame(rows, DOCS), labels)
    assert (once.weight == many.weight).all() and once.bias == many.bias


def test_empty_and_null_sites(spark):
    docs = spark.createDataFrame([(1, "a b c", None, None), (2, None, "en", "s"), (3, "", "en", "s")], DOCS)
    got = quality.scores(docs, spark.createDataFrame([], "doc_id bigint, quality int")).collect()
    assert sorted((r.doc_id, r.host, r.posterior > 0) for r in got) == [(1, "", True), (2, "s", False), (3, "s", False)]
    assert docs.where(F.col("doc_id") < 0).count() == quality.scores(docs.limit(0), spark.createDataFrame([], "doc_id bigint, quality int")).count() == 0
