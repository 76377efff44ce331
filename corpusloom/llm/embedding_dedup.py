"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one representative per group.

Equal vectors collapse first. Centroids are refined over all vectors; each vector has a home cell and also
visits the cells whose border is near enough for a neighbour to lie beyond it. Two vectors within the
threshold differ by at most ``delta = sqrt(2 - 2 * threshold)``. Where a border parts them their margins to it,
``x . (home - c) / |home - c|``, sum up to the part of that difference that is across the border, so one of the two is within half of it and
visits the other's cell: a vector visits cell c when its margin is at most ``slack * delta / sqrt(d) / 2``. With slack = sqrt(d) no pair can be
missed; the default of 3 covers three standard deviations of a difference without preferred direction.
A cell of more than ``SPLIT`` times its meant size is parted again, around vectors of its own, in the same way; so the number of centroids that
go to every task is bounded, and the work still doesn't grow with the square of the vectors.
Cells are compared in blocks, so a cell's size bounds no task, and groups are connected components.

Defined results: a null or empty vector, one with a null, NaN or infinite entry, of zero length, or a null
id takes no part. Vectors are compared with those of their own dimension.
Rows repeated under one id count as the least of its vectors. The representative is the group's least id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import BROADCAST_IDS, components, read_table, union_find, written

#: Vectors a cell holds on average, and the most cells there are (their centroids are sent to every task).
CELL = 2048
MAX_CELLS = 32_768
BLOCK = 4096
ROUNDS = 3
#: Times its meant size that a cell has before it is parted again, and vectors of a task that does so.
SPLIT, CHUNK = 64, 65_536


def _matrix(col: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float32).reshape(-1, d) if len(col) else np.zeros((0, d), np.float32)


def _rows_of(x: np.ndarray) -> pa.Array:
    """The rows of a float32 matrix as binary, in one buffer."""
    off = np.arange(len(x) + 1, dtype=np.int32) * np.int32(4 * (x.shape[1] if len(x) else 0))
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def _normalized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        vecs, ids = b["embedding"], b["vec_id"]
        off = vecs.offsets.to_numpy()
        flat = vecs.values.to_numpy(zero_copy_only=False)
        size = np.diff(off)
        for d in np.unique(size[size > 0]).tolist():
            at = np.flatnonzero(size == d)
            for k in range(0, len(at), step := max(1, (1 << 20) // d)):
                i = at[k : k + step]
                x = flat[off[i][:, None] + np.arange(d)].astype(np.float64)
                top = np.abs(x).max(axis=1)
                ok = np.isfinite(top) & (top > 0)
                i, x = i[ok], x[ok] / top[ok][:, None]
                x = (x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), _rows_of(x), pa.array(np.full(len(i), d, np.int32))], ["vec_id", "v", "d"])


def _assigned(x: np.ndarray, cells: np.ndarray, step: int = 4096) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(offset, cosines, home) in steps that bound memory."""
    step = max(16, min(step, (1 << 24) // max(1, len(cells))))
    for a in range(0, len(x), step):
        g = x[a : a + step] @ cells.T
        yield a, g, g.argmax(axis=1)


def _partial(cells: np.ndarray, d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            x = _matrix(b["v"], d)
            for a, _, home in _assigned(x, cells):
                order = np.argsort(home, kind="stable")
                at = np.flatnonzero(np.r_[True, np.diff(home[order]) > 0])
                for c, s in zip(home[order[at]].tolist(), np.add.reduceat(x[a + order].astype(np.float64), at, axis=0)):
                    sums[c] = sums[c] + s if c in sums else s
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["cell", "s"])

    return run


def _summed(t: pa.Table) -> pa.Table:
    s = np.stack([np.frombuffer(x, np.float64) for x in sorted(t["s"].to_pylist())]).sum(axis=0)
    return pa.table({"cell": t["cell"][:1], "s": pa.array([s.tobytes()], pa.binary())})


def kmeans(vectors: DataFrame, n: int, d: int, rounds: int = ROUNDS, cell: int = CELL, max_cells: int = MAX_CELLS) -> np.ndarray:
    """Centroids of ``vectors(vec_id, v)``, begun from the vectors whose ids have the least hashes."""
    k = min(max_cells, max(1, math.ceil(n / cell)))
    first = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(k).select("v").toArrow()
    cells = _matrix(first["v"].combine_chunks() if first.num_rows else first["v"], d).copy()
    for _ in range(rounds if k > 1 else 0):
        new = vectors.select("v").mapInArrow(_partial(cells, d), "cell int, s binary").groupBy("cell").applyInArrow(_summed, "cell int, s binary").toArrow()
        for c, s in zip(new["cell"].to_pylist(), new["s"].to_pylist()):
            s = np.frombuffer(s, np.float64)
            size = np.sqrt(s @ s)
            if size > 0:
                cells[c] = s / size
    return cells


def _visits(x: np.ndarray, cells: np.ndarray, reach: float, gap: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, cell, whether it is the row's home) in steps that bound memory."""
    for a, g, home in _assigned(x, cells):
        apart = gap[home] if gap is not None else np.sqrt(np.maximum(0, 2 - 2 * np.clip(cells[home] @ cells.T, -1, 1)))
        best = g[np.arange(len(home)), home]
        visit = best[:, None] - g <= reach * apart + 1e-6
        visit[np.arange(len(home)), home] = True
        row, cell = np.nonzero(visit)
        yield row + a, cell, cell == home[row]


def _gap(cells: np.ndarray) -> np.ndarray | None:
    return np.sqrt(np.maximum(0, 2 - 2 * np.clip(cells @ cells.T, -1, 1))) if len(cells) <= 4096 else None


def _placed(cells: np.ndarray, d: int, reach: float):
    gap = _gap(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, cell, home in _visits(_matrix(b["v"], d), cells, reach, gap):
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), b["vec_id"].take(at), b["v"].take(at), pa.array(home)], ["cell", "vec_id", "v", "home"])

    return run


def _reach(d: int, threshold: float, slack: float) -> float:
    return min(1.0, slack / math.sqrt(d)) * math.sqrt(max(0.0, 2 - 2 * threshold)) / 2


_PLACED = "d int, cell int, sub int, vec_id bigint, v binary, home boolean"


def _parted(threshold: float, slack: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["d", "cell", "sub", "vec_id", "v", "home"]
        left = left.append_column("sub", pa.array(np.zeros(len(left), np.int32))).select(names)
        if not len(left) or not len(right):
            return left
        d = left["d"][0].as_py()
        right = right.take(pa.array(np.argsort(right["seed_vec_id"].to_numpy())))
        cells = _matrix(right["seed_v"].combine_chunks(), d)
        parts = list(_visits(_matrix(left["v"].combine_chunks(), d), cells, _reach(d, threshold, slack), _gap(cells)))
        row, sub = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        return left.take(pa.array(row)).set_column(2, "sub", pa.array(sub, pa.int32()))

    return run


def _divided(placed: DataFrame, threshold: float, slack: float, cell: int, split: int) -> DataFrame:
    """``placed`` with ``sub``: the part of a cell above ``split * cell`` vectors that a row is in or visits; 0 in others.

    Such a cell's vectors gather around every ``cell``-th of its own, by a hash of the id; they are dealt out to tasks of about ``CHUNK``, each with all of those.
    """
    big = written(placed.groupBy("d", "cell").agg(F.count("*").alias("n")).where(F.col("n") > split * cell))
    if big.isEmpty():
        return placed.withColumn("sub", F.lit(0))
    side = F.broadcast(big) if big.count() <= BROADCAST_IDS else big
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    rows = placed.join(side, ["d", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("vec_id", F.lit(9)), chunks).cast("int"))
    of = side.toDF("seed_d", "seed_cell", "n")
    seeds = placed.toDF(*(f"seed_{c}" for c in placed.columns)).join(of, ["seed_d", "seed_cell"])
    seeds = seeds.where(F.col("seed_home") & (F.pmod(F.xxhash64("seed_vec_id", F.lit(5)), F.lit(cell)) == 0))
    seeds = seeds.select("seed_d", "seed_cell", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("seed_chunk"), "seed_vec_id", "seed_v")
    keys = ["d", "cell", "chunk"]
    parted = rows.select(*keys, "vec_id", "v", "home").groupBy(*keys).cogroup(seeds.groupBy(*(f"seed_{c}" for c in keys))).applyInArrow(_parted(threshold, slack), _PLACED)
    names = ["d", "cell", "sub", "vec_id", "v", "home"]
    whole = placed.join(side.select("d", "cell"), ["d", "cell"], "left_anti").withColumn("sub", F.lit(0))
    return written(whole.select(names).unionByName(parted.select(names)))


def _compared(threshold: float, step: int = 1024):
    def run(t: pa.Table) -> pa.Table:
        ids, home, part = t["vec_id"].to_numpy(), t["home"].to_numpy(), t["part"].to_numpy()
        lo, hi = t["lo"][0].as_py(), t["hi"][0].as_py()
        x = _matrix(t["v"].combine_chunks(), t["d"][0].as_py())
        one, two = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
        left, right = [], []
        for a in range(0, len(one), step):
            for b in range(a if lo == hi else 0, len(two), step):
                i, j = one[a : a + step], two[b : b + step]
                r, c = np.nonzero(x[i] @ x[j].T >= threshold - 1e-6)
                keep = (ids[i[r]] != ids[j[c]]) & (home[i[r]] | home[j[c]])
                left.append(ids[i[r[keep]]])
                right.append(ids[j[c[keep]]])
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (left, right))
        if len(a):
            a, b = union_find(a, b)
            a, b = a[a != b], b[a != b]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, slack: float = 3.0, cell: int = CELL, block: int = BLOCK, rounds: int = ROUNDS, max_cells: int = MAX_CELLS, split: int = SPLIT) -> DataFrame:
    """(rep_id, vec_id): every vector of a near-duplicate group other than its representative.

    :param threshold: the least cosine of a pair
    """
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    unit = rows.where("vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT exists(embedding, e -> e IS NULL)")
    unit = written(unit.mapInArrow(_normalized, "vec_id bigint, v binary, d int").groupBy("vec_id").agg(F.min(F.struct("v", "d")).alias("x")).select("vec_id", "x.v", "x.d"))
    reps = written(unit.groupBy("d", "v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n")))
    same = unit.join(reps.where("n > 1").select("v", F.col("vec_id").alias("b")), "v").where("vec_id <> b").select(F.col("vec_id").alias("a"), "b")
    # few vectors of a dimension are a cell; the others are parted into cells by dimension
    dims = {r["d"]: r["n"] for r in reps.groupBy("d").agg(F.count("*").alias("n")).where(F.col("n") > cell).collect()}
    placed = [reps.where(~F.col("d").isin(*dims)).select("d", F.lit(0).alias("cell"), "vec_id", "v", F.lit(True).alias("home"))]
    for d, n in sorted(dims.items()):
        own = reps.where(F.col("d") == d).select("vec_id", "v")
        cells = kmeans(own, n, d, rounds, cell, max_cells)
        got = own.mapInArrow(_placed(cells, d, _reach(d, threshold, slack)), "cell int, vec_id bigint, v binary, home boolean")
        placed.append(got.select(F.lit(d).alias("d"), "cell", "vec_id", "v", "home"))
    placed = _divided(written(reduce(DataFrame.unionByName, placed)), threshold, slack, cell, split)
    sizes = written(placed.groupBy("d", "cell", "sub").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")))
    side = F.broadcast(sizes) if sizes.count() <= BROADCAST_IDS else sizes
    parted = placed.join(side, ["d", "cell", "sub"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    paired = parted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    paired = paired.withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other"))
    near = paired.select("d", "cell", "sub", "lo", "hi", "part", "vec_id", "v", "home").groupBy("d", "cell", "sub", "lo", "hi").applyInArrow(_compared(threshold), "a bigint, b bigint")
    return components(same.union(near)).where("node <> comp").select(F.col("comp").alias("rep_id"), F.col("node").alias("vec_id"))


def op10_embedding_near_dedup(spark, sf_dir):
    """Every vector with the representative of its group; a vector without near-duplicates is its own."""
    vectors = read_table(spark, sf_dir, "embeddings")
    pairs = near_duplicates(vectors)
    ids = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id")).where("vec_id IS NOT NULL").distinct()
    return ids.join(pairs, "vec_id", "left").select("vec_id", F.coalesce("rep_id", "vec_id").alias("rep_id"), F.col("rep_id").isNull().alias("kept"))


QUERIES = {"op10_embedding_near_dedup": op10_embedding_near_dedup}
ORACLES = {
    "op10_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS len FROM v),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON list_dot_product(a.e, b.e) >= (0.95 - 1e-6) * a.len * b.len AND a.len > 0 AND b.len > 0),
r(x, y) AS (SELECT x, y FROM p UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x),
m AS (SELECT x AS vec_id, min(y) AS rep_id FROM r GROUP BY x)
SELECT DISTINCT v.vec_id, coalesce(m.rep_id, v.vec_id) AS rep_id, coalesce(m.rep_id, v.vec_id) = v.vec_id AS kept FROM v LEFT JOIN m USING (vec_id)"""
}
