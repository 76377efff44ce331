"""Mixing sources to target weights by cube-method balanced sampling.

Each source gets an inclusion probability that brings its expected tokens to its target share. The flight
phase of the cube method moves these probabilities through the null-space of the balancing constraints
(documents and tokens, per source) until they are 0 or 1: three undecided documents at a time have a
direction that changes neither total. Flights run in parallel over buckets of a source; what stays
undecided, two documents a bucket at most, is flown again by source, and the two that stay of each source are
the landing problem: the token constraint is given up first, then the count.

Defined results: a document is a doc_id, whose repeated rows are kept or dropped together and count once each
towards its tokens; a null doc_id makes one document of its rows. A null source is a source. Null, empty and
wordless texts have 0 tokens. A source without tokens, or without a target weight among given ones, has
probability 0 unless weights are not given; then a source without tokens is kept whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import BROADCAST_IDS, read_table, written

#: Documents a flight takes at once, about.
BUCKET = 20_000
#: Share of tokens is taken to this power for the default targets: 1 keeps the sources' proportions, 0 evens them out.
TEMPERATURE = 0.5
#: Share of the input's tokens that the default sample has.
BUDGET = 0.7
_EPS = 1e-9


def _uniform(seed: int, key: np.ndarray) -> np.ndarray:
    from corpusloom.llm.words import mix

    return (mix(key.astype(np.uint64) ^ mix(np.array([seed + 1], np.uint64))) >> np.uint64(11)).astype(np.float64) / 2.0**53


def flight(pi: np.ndarray, tokens: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Probabilities moved to 0 or 1, but for two at most, with sum(p) and sum(tokens) of the sample kept.

    :param pi: inclusion probabilities
    :param tokens: tokens of each document; the balanced total is the sum over documents of tokens * s
    :param u: a uniform number of each document, which decides the step it is settled in
    """
    p = pi.astype(np.float64).copy()
    t = tokens.astype(np.float64)
    free = [int(i) for i in np.flatnonzero((p > _EPS) & (p < 1 - _EPS))]
    p[p <= _EPS] = 0.0
    p[p >= 1 - _EPS] = 1.0
    P, T, U = p.tolist(), t.tolist(), u.tolist()
    free.reverse()
    active: list[int] = []
    while True:
        while len(active) < 3 and free:
            active.append(free.pop())
        if len(active) < 3:
            break
        a, b, c = active
        # direction orthogonal to (1, 1, 1) and to the tokens
        x, y, z = T[c] - T[b], T[a] - T[c], T[b] - T[a]
        if x == 0 and y == 0:
            x, y, z = 1.0, -1.0, 0.0
        up = down = math.inf
        for v, q in ((x, P[a]), (y, P[b]), (z, P[c])):
            if v > 0:
                up, down = min(up, (1 - q) / v), min(down, q / v)
            elif v < 0:
                up, down = min(up, q / -v), min(down, (1 - q) / -v)
        step = up if U[a] * (up + down) < down else -down
        U[a] = (U[a] * 7919.0 + U[b] + U[c]) % 1.0
        left = []
        for i, v in ((a, x), (b, y), (c, z)):
            q = P[i] + step * v
            P[i] = 0.0 if q <= _EPS else 1.0 if q >= 1 - _EPS else q
            if 0.0 < P[i] < 1.0:
                left.append(i)
        if len(left) == 3:  # rounding: settle the nearest
            i = min(left, key=lambda j: min(P[j], 1 - P[j]))
            P[i] = round(P[i])
            left.remove(i)
        active = left
    return np.array(P)


def landing(p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The last few undecided: pairs keep their count, a single one is drawn."""
    p = p.copy()
    free = [int(i) for i in np.flatnonzero((p > 0) & (p < 1))]
    while len(free) >= 2:
        a, b = free[:2]
        up, down = min(1 - p[a], p[b]), min(p[a], 1 - p[b])
        step = up if u[a] * (up + down) < down else -down
        for i, v in ((a, step), (b, -step)):
            p[i] += v
            if p[i] <= _EPS or p[i] >= 1 - _EPS:
                p[i] = round(p[i])
                free.remove(i)
        u = np.roll((u * 7919.0 + 0.123) % 1.0, 1)
    for i in free:
        p[i] = float(u[i] < p[i])
    return p


def _flown(seed: int, last: bool):
    def run(t: pa.Table) -> pa.Table:
        ids = t["h"].to_numpy()
        order = np.lexsort((t["n_tokens"].to_numpy(), ids))
        t = t.take(pa.array(order))
        u = _uniform(seed + int(last), t["h"].to_numpy().view(np.uint64))
        p = flight(t["p"].to_numpy(), t["n_tokens"].to_numpy(), u)
        if last:
            p = landing(p, _uniform(seed + 2, t["h"].to_numpy().view(np.uint64)))
        return t.set_column(t.schema.get_field_index("p"), "p", pa.array(p)).select(_COLUMNS)

    return run


_COLUMNS = ["doc_id", "source", "n_tokens", "pi", "h", "p"]
_SCHEMA = "doc_id bigint, source string, n_tokens bigint, pi double, h bigint, p double"


def _filled(rows: DataFrame, tokens: float) -> float:
    """The scale at which ``least(t, scale * w)`` sums up to ``tokens``: whole sources are set aside until no more turn up."""
    scale, whole = 0.0, -1
    while True:
        full = F.col("t") <= scale * F.col("w")
        r = rows.where("w IS NOT NULL").agg(F.sum(full.cast("bigint")).alias("whole"), F.sum(F.when(full, F.col("t"))).alias("t"), F.sum(F.when(~full, F.col("w"))).alias("w")).first()
        if not r["w"]:  # all are whole, or there are none
            return scale
        if r["whole"] == whole:
            return scale
        whole, scale = r["whole"], max(scale, (tokens - (r["t"] or 0.0)) / r["w"])


def probabilities(units: DataFrame, weights: dict[str, float] | None = None, tokens: float | None = None) -> DataFrame:
    """(source, pi, n): inclusion probabilities that bring each source's tokens to its target share.

    Without ``tokens``, given weights get the largest total that needs no document twice, and the default ones ``BUDGET`` of
    the input's tokens. A source that has less than its share of a total is kept whole, and the others share what is left.
    """
    rows = units.groupBy("source").agg(F.sum("n_tokens").cast("double").alias("t"), F.count("*").alias("n"))
    if weights is None:
        rows = rows.withColumn("w", F.when(F.col("t") > 0, F.pow("t", F.lit(TEMPERATURE))))
    else:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]) if weights else None
        rows = rows.withColumn("w", F.when((F.col("t") > 0) & (F.element_at(given, F.coalesce("source", F.lit(""))) > 0), F.element_at(given, F.coalesce("source", F.lit(""))))) if weights else rows.withColumn("w", F.lit(None).cast("double"))
    rows = written(rows)
    if weights is None and tokens is None:
        tokens = BUDGET * (rows.agg(F.sum("t")).first()[0] or 0.0)
    scale = _filled(rows, tokens) if tokens is not None else rows.agg(F.min(F.col("t") / F.col("w"))).first()[0] or 0.0
    none = 1.0 if weights is None else 0.0
    pi = F.when(F.col("w").isNull(), F.lit(none)).otherwise(F.least(F.lit(1.0), F.lit(scale) * F.col("w") / F.col("t")))
    return rows.select("source", pi.alias("pi"), "n")


def decisions(
    docs: DataFrame, weights: dict[str, float] | None = None, tokens: float | None = None, seed: int = 11, bucket: int = BUCKET
) -> DataFrame:
    """(doc_id, source, n_tokens, pi, p): p is 1 for the documents of the sample and 0 for the others.

    :param weights: target share of each source's tokens; by default its tokens to the power ``TEMPERATURE``
    :param tokens: expected tokens of the sample; see :func:`probabilities`
    """
    units = written(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"\S+")), F.lit(0)).cast("bigint").alias("n_tokens"),
        )
        .groupBy("doc_id").agg(F.min("source").alias("source"), F.sum("n_tokens").alias("n_tokens"))
    )
    pis = written(probabilities(units, weights, tokens))
    side = F.broadcast(pis) if pis.count() <= BROADCAST_IDS else pis
    side = side.select(F.col("source").alias("s"), "pi", F.greatest(F.lit(1), F.ceil(F.col("n") / bucket)).alias("parts"))
    rows = units.join(side, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("p", F.col("pi"))
    settled = rows.where(f"pi <= {_EPS} OR pi >= {1 - _EPS}").withColumn("p", F.rint("pi")).select(_COLUMNS)
    open_ = rows.where(f"pi > {_EPS} AND pi < {1 - _EPS}").withColumn("part", F.pmod(F.xxhash64("h"), F.col("parts")))
    first = written(open_.groupBy("source", "part").applyInArrow(_flown(seed, False), _SCHEMA))
    again = first.where("p > 0 AND p < 1")
    while again.groupBy("source").count().where(f"count > {2 * bucket}").limit(1).count():
        parts = F.greatest(F.lit(1), F.ceil(F.count("*").over(_by_source()) / bucket))
        flown = again.withColumn("part", F.pmod(F.xxhash64("h", F.lit(seed)), parts)).groupBy("source", "part").applyInArrow(_flown(seed, False), _SCHEMA)
        first = written(first.where("p = 0 OR p = 1").unionByName(flown))
        again = first.where("p > 0 AND p < 1")
    landed = again.groupBy("source").applyInArrow(_flown(seed, True), _SCHEMA)
    out = settled.unionByName(first.where("p = 0 OR p = 1")).unionByName(landed)
    return out.select("doc_id", "source", "n_tokens", "pi", F.col("p").cast("int").alias("kept"))


def _by_source():
    from pyspark.sql import Window

    return Window.partitionBy("source")


def sample(docs: DataFrame, weights: dict[str, float] | None = None, tokens: float | None = None, seed: int = 11, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """The sampled rows of ``docs``, all columns as they were.

    Only the ids that the sample leaves out are matched: they are broadcast while their count allows, and
    shuffled beyond.
    """
    from corpusloom.llm.common import without

    gone = written(decisions(docs, weights, tokens, seed).where("kept = 0").select("doc_id"))
    out = without(docs, gone.where("doc_id IS NOT NULL"), broadcast_rows=broadcast_ids)
    return out.where("doc_id IS NOT NULL") if gone.where("doc_id IS NULL").limit(1).count() else out


def op8_cube_mixing(spark, sf_dir):
    """The documents of the sample."""
    return decisions(read_table(spark, sf_dir, "documents")).where("kept = 1").select("doc_id", "source", "n_tokens", "pi")


QUERIES = {"op8_cube_mixing": op8_cube_mixing}
ORACLES: dict[str, str] = {}
