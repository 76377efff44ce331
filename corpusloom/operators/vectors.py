"""Exact nearest neighbours: queries against all vectors, compared in blocks by matrix products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in col.to_pylist()])


def _best(k: int):
    def run(t: pa.Table) -> pa.Table:
        ids, side = t["vec_id"].to_numpy(), t["query"].to_numpy(zero_copy_only=False)
        x = _matrix(t["embedding"])
        norm = np.sqrt((x * x).sum(axis=1))
        q, c = np.flatnonzero(side), np.flatnonzero(~side)
        c = c[np.argsort(ids[c])]  # equal similarities rank by id
        out = []
        for a in range(0, len(q), 512):
            i = q[a : a + 512]
            s = np.round((x[i] @ x[c].T) / (norm[i][:, None] * norm[c][None, :] + 1e-8), 9)
            s[ids[i][:, None] == ids[c][None, :]] = -np.inf
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            r = np.repeat(np.arange(len(i)), top.shape[1])
            keep = np.isfinite(s[r, top.ravel()])
            out.append((ids[i][r][keep], ids[c][top.ravel()][keep], s[r, top.ravel()][keep]))
        a, b, s = (np.concatenate(v) for v in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "s": pa.array(s)})

    return run


def top_k(vectors: DataFrame, k: int = 3, block: int = 4096, queries: Column | None = None) -> DataFrame:
    """(query_id, rank, vec_id, s): the k most similar other vectors of each of ``vectors(vec_id, embedding)``, or of those that ``queries`` says.

    Rows with a null id or vector, or a null entry, take no part; neither do ids of another dimension for each other. Queries and vectors are cut into blocks by a hash of the id;
    a task compares one block with another and hands on k candidates a query. The answer is exact, and the work is that of
    all queries against all rows; what is sent is the queries times the blocks of rows, and the rows times the blocks of queries.
    """
    rows = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT exists(embedding, e -> e IS NULL)").select("vec_id", "embedding", F.size("embedding").alias("d"))
    asked = rows if queries is None else rows.where(queries)
    every, some = (max(1, -(-df.count() // block)) for df in (rows, asked))
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sides = asked.select("d", part(some).alias("q"), each(every).alias("c"), F.lit(True).alias("query"), "vec_id", "embedding").unionByName(
        rows.select("d", each(some).alias("q"), part(every).alias("c"), F.lit(False).alias("query"), "vec_id", "embedding")
    )
    best = sides.groupBy("d", "q", "c").applyInArrow(_best(k), "query_id bigint, vec_id bigint, s double")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "s")
