"""Quality classifier with hierarchical empirical Bayes over hosts and their paths.

A logistic model on surface features of the text gives each document's evidence. Hosts and paths gather the
evidence of all their documents; each host's posterior mean is shrunk to the global mean and each path's to
its host's, with prior strengths estimated by the method of moments. The document's log odds are then moved
by how far its path's posterior lies from the global mean.

Host and path come from ``source``: a URL's host and first path segment, or the parts around the first
slash; a source with neither is the host, and the language is its path.

Defined results: a null text, or one without words, has evidence 0, is rejected, and tells nothing about its
site. A null source or lang is a site of its own. Without labels of both classes every text with words gets
the share of positive labels (1 where there are none). Repeated rows are scored alike; of a labelled id's texts the first
in order is learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import fresh, quoted, read_table, written
from corpusloom.llm.words import as_texts, chunks, mix, text_buffer, words

#: Labelled documents that the classifier is fitted on, at most: those with the least hash of their id.
TRAIN_ROWS = 20_000
#: Site tables up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_SITES = 200_000
FEATURES = 15

_CLASS = np.full(256, 6, np.uint8)  # other symbols
_CLASS[[*range(97, 123), *range(128, 256)]] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[32, 9, 13]] = 3
_CLASS[10] = 4
_CLASS[[ord(c) for c in ".,;:'\"-()"]] = 5
_CLASS[[ord(c) for c in "!?"]] = 7


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]]."""
    run = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=run[1:])
    return (run[first[1:]] - run[first[:-1]]).astype(np.float64)


def _distinct(key: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """How many distinct keys each document has; ``doc`` ascends, so sorting documents' bits first is enough."""
    if not len(key):
        return np.zeros(n)
    top = np.uint64(max(1, 64 - int(n).bit_length()))
    both = np.sort(doc.astype(np.uint64) << top | key >> np.uint64(64) - top)
    fresh = np.r_[True, both[1:] != both[:-1]]
    return np.bincount((both[fresh] >> top).astype(np.int64), minlength=n).astype(np.float64)


def features(texts: pa.Array) -> np.ndarray:
    """(n, FEATURES): shares of character classes, word lengths, repetition. Rows without words are NaN."""
    texts = as_texts(texts)
    parts = [_features(texts.slice(i, j - i)) for i, j in chunks(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, FEATURES))


def _features(texts: pa.Array) -> np.ndarray:
    buf, off = text_buffer(texts)
    w = words(texts)
    n = len(texts)
    kind = _CLASS[buf]
    by = [_sums(kind == c, off) for c in range(8)]
    size = np.maximum(np.diff(off), 1.0)
    count = np.diff(w.first).astype(np.float64)
    doc = w.doc
    has = np.maximum(count, 1.0)
    length = (w.end - w.start).astype(np.float64)
    same = np.zeros(len(doc), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    pair = np.zeros(len(doc), np.uint64)
    pair[1:] = mix(w.hash[1:] ^ (w.hash[:-1] * np.uint64(3)))
    begin = w.first[:-1][count > 0]
    pair[begin] = mix(w.hash[begin])  # a text's first word has none before it, whatever text comes before
    total = np.bincount(doc, length, n)
    out = np.stack(
        [
            np.log1p(count),
            by[1] / np.maximum(by[0] + by[1], 1),
            by[6] / size,
            by[2] / size,
            by[5] / size,
            by[7] / size,
            by[4] / size,
            total / has,
            np.sqrt(np.maximum(np.bincount(doc, length**2, n) / has - (total / has) ** 2, 0)),
            np.bincount(doc, length <= 3, n) / has,
            np.bincount(doc, same, n) / has,
            _distinct(w.hash, doc, n) / has,
            _distinct(pair, doc, n) / has,
            np.log1p(by[6] / has),
            np.log1p(by[7] / has),
        ],
        axis=1,
    )
    out[count == 0] = np.nan
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight + self.bias
        return np.clip(z, -12, 12)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> Model:
    """Penalized logistic regression by Newton's method; constant where a class is missing."""
    ok = ~np.isnan(x).any(axis=1) if len(x) else np.zeros(0, bool)
    x, y = x[ok], y[ok].astype(np.float64)
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), -12.0 if len(y) and y[0] == 0 else 12.0)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.c_[np.clip((x - mean) / scale, -8, 8), np.ones(len(x))]
    b = np.zeros(FEATURES + 1)
    cost = np.r_[np.full(FEATURES, ridge), 1e-6]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(cost), z.T @ (y - p) - cost * b)
        b += step
        if np.abs(step).max() < 1e-6:
            break
    return Model(mean, scale, b[:-1], float(b[-1]))


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        f = features(b["text"])
        off = pa.array(np.arange(0, f.size + 1, FEATURES, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([b["y"], pa.ListArray.from_arrays(off, pa.array(f.ravel()))], ["y", "f"])


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """The model fitted on at most ``train_rows`` labelled documents; conflicting labels of an id are averaged."""
    sample = (
        labels.select(F.col("doc_id").cast("bigint").alias("__loom_id"), F.col("quality").cast("double").alias("q"))
        .where("__loom_id IS NOT NULL AND q IS NOT NULL")
        .groupBy("__loom_id").agg((F.avg("q") >= 0.5).cast("int").alias("y"))
        .orderBy(F.xxhash64("__loom_id"), "__loom_id").limit(train_rows)
    )
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    text = text.where("text IS NOT NULL").join(F.broadcast(sample), F.col("doc_id") == F.col("__loom_id"))
    text = text.groupBy("doc_id").agg(F.first("y").alias("y"), F.min("text").alias("text"))  # one row an id, so that their number is bounded
    rows = text.select("y", "text").mapInArrow(_training, "y int, f array<double>").toPandas()
    x = np.array(rows["f"].tolist(), np.float64).reshape(-1, FEATURES)
    order = np.lexsort(np.nan_to_num(x, nan=-1.0).T)  # the result doesn't depend on the order of tasks
    return fit(x[order], rows["y"].to_numpy()[order])


def evidence(model: Model):
    """Arrow function: text to log odds, null where there are no words.

    Declared nondeterministic so that the optimizer never evaluates it twice, for a filter and for its value.
    """

    @F.arrow_udf("double")
    def run(text: pa.Array) -> pa.Array:
        z = model.logit(features(text))
        return pa.array(z, mask=np.isnan(z))

    return run.asNondeterministic()


def site(source: Column, lang: Column) -> Column:
    """struct(host, path)."""
    s = F.coalesce(source.cast("string"), F.lit("")).alias("s")
    url = s.rlike("^[A-Za-z][A-Za-z0-9+.-]*://")
    bare = F.when(url, F.regexp_replace(s, "^[^:]+://", "")).otherwise(s)
    host = F.element_at(F.split(bare, "[/?#]", 2), 1)
    rest = F.regexp_extract(bare, "^[^/?#]*/([^/?#]*)", 1)
    path = F.when(url | bare.contains("/"), rest).otherwise(F.coalesce(lang.cast("string"), F.lit("")))
    return F.struct(F.when(url, F.lower(host)).otherwise(host).alias("host"), path.alias("path"))


def _strength(rows: DataFrame, mean: str, prior: str) -> float:
    """Prior strength by the method of moments: how little group means vary beyond what their sizes explain."""
    got = rows.agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.pow(F.col(mean) - F.col(prior), 2)).alias("between"),
        F.sum(F.greatest(F.lit(0.0), F.col("s2") - F.col("n") * F.pow(F.col(mean), 2))).alias("within"),
        F.sum(F.col("n") * F.col("n")).alias("nn"), F.count("*").alias("k"), F.avg(prior).alias("mu"),
    ).first()
    if not got["n"] or got["k"] < 2 or got["n"] <= got["k"]:
        return 10.0
    within = got["within"] / (got["n"] - got["k"])
    spread = (got["between"] - (got["k"] - 1) * within) / max(got["n"] - got["nn"] / got["n"], 1e-9)
    mu = min(max(got["mu"], 1e-6), 1 - 1e-6)
    return float(min(1e6, max(1.0, mu * (1 - mu) / max(spread, 1e-12) - 1)))


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, float]:
    """(host, path, n, host_post, path_post) from ``scored(host, path, z)``, and the global mean."""
    p = 1 / (1 + F.exp(-F.col("z")))
    paths = written(
        scored.where("z IS NOT NULL").groupBy("host", "path")
        .agg(F.count("*").alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("s2"))
    )
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mu = min(max(total["s"] / total["n"], 1e-6), 1 - 1e-6) if total["n"] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("s2").alias("s2"))
    hosts = hosts.withColumn("m", F.col("s") / F.col("n")).withColumn("mu", F.lit(mu))
    k = _strength(hosts, "m", "mu")
    hosts = hosts.select("host", ((F.col("s") + k * mu) / (F.col("n") + k)).alias("host_post"))
    both = paths.join(hosts, "host").withColumn("m", F.col("s") / F.col("n"))
    k = _strength(both, "m", "host_post")
    post = (F.col("s") + k * F.col("host_post")) / (F.col("n") + k)
    clipped = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), post))
    return written(both.select("host", "path", "n", "host_post", clipped.alias("path_post"))), mu


def _sided(sites: DataFrame, limit: int) -> DataFrame:
    return F.broadcast(sites) if sites.count() <= limit else sites


def scores(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, broadcast_sites: int = BROADCAST_SITES) -> DataFrame:
    """(doc_id, host, path, p_doc, host_post, path_post, posterior) of every row of ``docs``."""
    model = train(docs, labels, train_rows)
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        site(F.col("source"), F.col("lang")).alias("site"),
        evidence(model)(F.col("text").cast("string")).alias("z"),
    ).select("doc_id", "site.host", "site.path", "z")
    rows = written(rows)
    sites, mu = site_posteriors(rows)
    return rows.join(_sided(sites, broadcast_sites), ["host", "path"], "left").select(
        "doc_id", "host", "path", F.coalesce(1 / (1 + F.exp(-F.col("z"))), F.lit(0.0)).alias("p_doc"),
        "host_post", "path_post", _posterior(mu).alias("posterior"),
    )


def _posterior(mu: float) -> Column:
    odds = lambda c: F.log(c / (1 - c))
    z = F.col("z") + F.coalesce(odds(F.col("path_post")), F.lit(0.0)) - odds(F.lit(mu))
    return F.coalesce(1 / (1 + F.exp(-z)), F.lit(0.0))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, train_rows: int = TRAIN_ROWS, broadcast_sites: int = BROADCAST_SITES) -> DataFrame:
    """The rows of ``docs`` whose posterior reaches the threshold, all columns as they were.

    The texts are scored again in the pass that filters them: that costs less than shuffling them to their scores.
    """
    model = train(docs, labels, train_rows)
    z = evidence(model)(F.col("text").cast("string"))
    where = site(F.col("source"), F.col("lang"))
    rows = docs.select(where.alias("site"), z.alias("z")).select("site.host", "site.path", "z")
    sites, mu = site_posteriors(rows)
    own, odds, host, path, post = fresh(docs, "__loom_site", "__loom_z", "__loom_host", "__loom_path", "__loom_post")
    side = _sided(sites.select(F.col("host").alias(host), F.col("path").alias(path), F.col("path_post").alias(post)), broadcast_sites)
    out = docs.withColumn(own, where).withColumn(odds, z).where(F.col(odds).isNotNull())
    out = out.join(side, (F.col(own)["host"] == F.col(host)) & (F.col(own)["path"] == F.col(path)), "left")
    shift = F.coalesce(F.log(F.col(post) / (1 - F.col(post))), F.lit(0.0)) - float(np.log(mu / (1 - mu)))
    need = float(np.log(threshold / (1 - threshold)))
    return out.where(F.col(odds) + shift >= need).select(*quoted(docs.columns))


def op5_quality_classifier(spark, sf_dir):
    """The documents that are kept, with the evidence for them."""
    return scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).where("posterior >= 0.5")


QUERIES = {"op5_quality_classifier": op5_quality_classifier}
ORACLES: dict[str, str] = {}
