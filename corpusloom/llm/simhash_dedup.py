"""SimHash near-dedup by random bit sampling.

Each text becomes a 256-bit SimHash of its distinct words. Equal fingerprints collapse first. Every table
groups the rest by a few sampled coordinates (more of them as the corpus grows, so a bucket keeps its
expected size); their number gives that of the tables, by which a pair at the threshold is found with
probability ``RECALL`` at any size. A bucket above ``cap`` is divided by additional bits until its parts fit, again
and again by other bits until such a pair has stayed together with probability ``TOGETHER``, or compared whole where
that is less work. All pairs of a bucket are verified by Hamming distance, and groups are the connected components of the verified pairs.

Defined results: a null text or a null doc_id takes no part (the row stays, in no group). A text without
words, empty ones included, is fingerprinted by its exact characters, so only exact copies of it match.
Rows repeated under one doc_id count as one document, which is near whatever one of its texts is near. The representative is the
group's least doc_id. :func:`keep_one` decides by row instead.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import BROADCAST_IDS, components, fresh, quoted, read_table, union_find, without, written
from corpusloom.llm.words import as_texts, chunks, mix, text_hash, words

WORDS = 4
BITS = 64 * WORDS
FP = [f"f{i}" for i in range(WORDS)]
RECALL, TOGETHER = 0.9, 0.95
_LANE = [np.uint64(0x9E3779B97F4A7C15 * (i + 1) & (1 << 64) - 1) for i in range(WORDS)]


def fingerprint(texts: pa.Array) -> np.ndarray:
    """(n, 4) uint64: the majority of the hash bits of each text's distinct words."""
    texts = as_texts(texts)
    parts = [_fingerprint(texts.slice(i, j - i)) for i, j in chunks(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, WORDS), np.uint64)


def _fingerprint(texts: pa.Array) -> np.ndarray:
    w = words(texts)
    n = len(w.first) - 1
    doc, h = w.doc, w.hash
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    doc, h = doc[new], h[new]
    bare = np.flatnonzero(np.diff(w.first) == 0)
    if len(bare):  # the text itself is the only feature
        doc = np.concatenate([doc, bare])
        h = np.concatenate([h, text_hash(texts.take(pa.array(bare)))])
        order = np.argsort(doc, kind="stable")
        doc, h = doc[order], h[order]
    votes = np.zeros((n, BITS), np.int32)
    step = 1 << 14
    for a in range(0, len(h), step):
        x, d = h[a : a + step], doc[a : a + step]
        lanes = np.stack([mix(x + lane) for lane in _LANE], axis=1)
        bits = np.unpackbits(lanes.view(np.uint8), axis=1, bitorder="little")
        at = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        size = np.diff(np.r_[at, len(d)])
        votes[d[at]] += 2 * np.add.reduceat(bits, at, axis=0, dtype=np.int32) - size[:, None].astype(np.int32)
    return np.packbits(votes > 0, axis=1, bitorder="little").view(np.uint64)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = fingerprint(b["text"]).view(np.int64)
        yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(fp[:, i]) for i in range(WORDS))], ["doc_id", *FP])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, f0..f3) of the rows that have a doc_id and a text."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(
        _fingerprints, "doc_id bigint, " + ", ".join(f"{f} bigint" for f in FP)
    )


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int32)


def times(p: float, recall: float) -> int:
    """Independent trials of which one succeeds with probability ``recall``, each with ``p``."""
    return 1 if p >= recall else math.ceil(math.log(1 - recall) / math.log1p(-p)) if p > 1e-12 else 1 << 60


def agreement(k: int, threshold: int, known: int = 0) -> float:
    """Probability that a pair at ``threshold`` agrees in ``k`` coordinates, drawn from those besides ``known`` equal ones."""
    return math.prod(max(0, BITS - threshold - i) / max(1, BITS - i) for i in range(known, known + k))


def sampled_bits(n: int, tables: int, seed: int, threshold: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """For each table the sampled coordinates, and a full order of the others to divide buckets by; ``tables`` at least."""
    k = int(min(40, max(6, round(math.log2(max(n, 2))) - 8)))
    tables = max(tables, times(TOGETHER * agreement(k, threshold), RECALL))
    rng = np.random.default_rng(seed)
    orders = np.array([rng.permutation(BITS) for _ in range(tables)])
    return orders[:, :k], orders[:, k:]


def _keys(bits: np.ndarray):
    k = bits.shape[1]
    weight = (np.uint64(1) << np.arange(k, dtype=np.uint64))[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.stack([b[f].to_numpy().view(np.uint64) for f in FP], axis=1)
            flat = np.unpackbits(fp.view(np.uint8), axis=1, bitorder="little")
            key = np.stack([(flat[:, at].astype(np.uint64) @ weight)[:, 0] for at in bits], axis=1)
            key = (key * np.uint64(len(bits)) + np.arange(len(bits), dtype=np.uint64)).astype(np.int64)
            off = np.arange(0, key.size + 1, len(bits), dtype=np.int32)
            keys = pa.ListArray.from_arrays(pa.array(off), pa.array(key.ravel()))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ["doc_id", *FP]), keys], ["doc_id", *FP, "keys"])

    return run


def _divided(run: np.ndarray, fp: np.ndarray, key: np.ndarray, more: np.ndarray, cap: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """New run numbers, in which runs above ``cap`` are divided by additional bits until each part fits; and by how many bits that differ."""
    used, told = np.zeros(len(run), np.int64), np.zeros(len(run), np.int64)
    while True:
        size = np.bincount(run)
        big = (size > cap)[run] & (used < more.shape[1])
        if not big.any():
            return run, told
        at = np.flatnonzero(big)
        extra = np.maximum(1, np.ceil(np.log2(size[run[at]] / cap))).astype(np.int64)
        part = np.zeros(len(at), np.int64)
        table = key[at] % tables
        for j in range(int(min(extra.max(), 16))):
            use = (extra > j) & (used[at] + j < more.shape[1])
            bit = more[table, np.minimum(used[at] + j, more.shape[1] - 1)]
            one = np.where(use, (fp[at, bit // 64] >> (bit % 64).astype(np.uint64) & np.uint64(1)).astype(np.int64), 0)
            ones = np.bincount(run[at], one, len(size))
            told[at] += ((ones > 0) & (ones < size))[run[at]]
            part |= one << j
        used[at] += np.minimum(extra, 16)
        new = run.astype(np.int64) << 17
        new[at] |= part + 1
        run = np.unique(new, return_inverse=True)[1]


def _joined(doc: np.ndarray, fp: np.ndarray, key: np.ndarray, run: np.ndarray, more: np.ndarray, cap: int, tables: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of the near pairs of each run; runs above ``cap`` in repeated divisions, or whole."""
    a, b = [], []

    def take(at: np.ndarray, parts: np.ndarray) -> None:
        x, y = _verified(doc[at], fp[at], parts, threshold)
        a.append(x)
        b.append(y)

    size = np.bincount(run)
    take(at := np.flatnonzero(size[run] <= cap), run[at])
    at = np.flatnonzero(size[run] > cap)
    done, orders = np.zeros(len(size), np.int64), np.random.default_rng(len(more))
    # repetitions still due: of each run by the bits its parts of the first division have taken
    due = None
    while len(at):
        parts, told = _divided(np.unique(run[at], return_inverse=True)[1], fp[at], key[at], more, cap, tables)
        bits = np.zeros(len(size), np.int64)
        np.maximum.at(bits, run[at], told)
        if due is None:
            due = np.array([times(agreement(e, threshold, BITS - more.shape[1]), TOGETHER) for e in range(int(bits.max()) + 1)])[bits]
            whole = (due >= size / cap)[run[at]]
            take(at[whole], run[at[whole]])
            at, parts = at[~whole], parts[~whole]
        if len(at):
            take(at, parts)
        done[run[at]] += 1
        at = at[(done < due)[run[at]]]
        more = orders.permuted(more, axis=1)
    return np.concatenate(a), np.concatenate(b)


def _verified(doc: np.ndarray, fp: np.ndarray, run: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (later, earlier row) of equal run whose distance is within the threshold, one link a row and step."""
    order = np.argsort(run, kind="stable")
    doc, fp, run = doc[order], fp[order], run[order]
    a, b, at, d, n = [], [], np.arange(len(run)), 1, 0
    lane = [np.ascontiguousarray(fp[:, i]) for i in range(WORDS)]
    while True:
        at = at[at < len(run) - d]
        at = at[run[at] == run[at + d]]
        if not len(at):
            break
        x, y = at, at + d
        near = np.zeros(len(x), np.int32)
        for i in range(WORDS):  # distances only grow: pairs beyond the threshold are left early
            near = near + np.bitwise_count(lane[i][x] ^ lane[i][y])
            keep = near <= threshold
            x, y, near = x[keep], y[keep], near[keep]
        a.append(doc[x])
        b.append(doc[y])
        n += len(x)
        if n > 1 << 21:  # stars hold the same links
            p, q = union_find(np.concatenate(a), np.concatenate(b))
            a, b, n = [p[p != q]], [q[p != q]], 0
        d += 1
    cat = lambda v: np.concatenate(v) if v else np.zeros(0, np.int64)
    return cat(a), cat(b)


def _pairs(more: np.ndarray, tables: int, threshold: int, cap: int, rows: int = 100_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(t: pa.Table) -> pa.RecordBatch:
            key, doc = t["key"].to_numpy(), t["doc_id"].to_numpy()
            fp = np.stack([t[f].to_numpy().view(np.uint64) for f in FP], axis=1)
            runs = np.cumsum(np.r_[0, key[1:] != key[:-1]])
            a, b = _joined(doc, fp, key, runs, more, cap, tables, threshold)
            if len(a):  # a star for each component holds the same links in fewer rows
                a, b = union_find(a, b)
                a, b = a[a != b], b[a != b]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        kept: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            kept.append(batch)
            n += len(batch)
            if n < rows:
                continue
            t = pa.Table.from_batches(kept)
            key = t["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last bucket may go on in the next batch
            if cut:
                yield solve(t.slice(0, cut))
            rest = t.slice(cut)
            kept, n = rest.to_batches(), len(rest) if cut else 0
        if kept:
            yield solve(pa.Table.from_batches(kept))

    return run


def near_duplicates(docs: DataFrame, threshold: int = 40, tables: int = 24, cap: int = 1000, seed: int = 7) -> DataFrame:
    """(rep_id, doc_id): every document of a near-duplicate group other than its representative.

    :param threshold: the greatest Hamming distance, of 256 bits, of a pair
    :param tables: least number of independent bit samples; there are more where the corpus' size asks for them
    :param cap: rows of a bucket from which on it is divided by additional bits
    """
    fps = written(fingerprints(docs))
    reps = written(fps.groupBy(*FP).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")))
    n = reps.count()
    bits, more = sampled_bits(n, tables, seed, threshold)
    hot = reps.where("n > 1").select(F.col("doc_id").alias("b"), *FP)
    same = fps.join(hot, FP).where("doc_id <> b").select(F.col("doc_id").alias("a"), "b")
    schema = "doc_id bigint, " + ", ".join(f"{f} bigint" for f in FP)
    buckets = (
        reps.select("doc_id", *FP)
        .mapInArrow(_keys(bits), schema + ", keys array<bigint>")
        .select("doc_id", *FP, F.explode("keys").alias("key"))
        .repartition("key")
        .sortWithinPartitions("key")
    )
    near = buckets.mapInArrow(_pairs(more, len(bits), threshold, cap), "a bigint, b bigint")
    return (
        components(same.union(near))
        .where("node <> comp")
        .select(F.col("comp").alias("rep_id"), F.col("node").alias("doc_id"))
    )


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, all columns as they were.

    Rows without doc_id or text stay. Rows of one doc_id with equal texts are one document, of which the least row stays; rows
    with different texts are documents of their own, so that no text goes for another's sake.
    """
    again = written(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return without(docs, written(near_duplicates(docs, **params).select("doc_id").distinct()))
    key, md5, unit, row, id_, m = fresh(docs, "__loom_key", "__loom_md5", "__loom_unit", "__loom_row", "__loom_id", "__loom_m")
    side = F.broadcast(again) if again.count() <= BROADCAST_IDS else again.hint("shuffle_hash")
    side = side.select(F.col("doc_id").alias(key))
    text = F.col("text").cast("string")
    twice = docs.join(side, docs["doc_id"] == side[key], "left_semi").withColumn(md5, F.md5(text))
    # a large number for each text of such an id, so that other ids are the representatives; drawn anew should any be taken already
    units = twice.where(F.col(md5).isNotNull()).select(F.col("doc_id").cast("bigint").alias(id_), F.col(md5).alias(m)).distinct()
    once = without(docs, again)
    salt = 0
    while True:
        named = written(units.withColumn(unit, F.shiftrightunsigned(F.xxhash64(F.lit(salt), id_, m), 2) + F.lit(1 << 62)))
        taken = named.join(once.select(F.col("doc_id").cast("bigint").alias(unit)), unit, "left_semi")
        if taken.isEmpty() and named.select(unit).distinct().count() == named.count():
            break
        salt += 1
    least = F.xxhash64(*quoted([c for c, t in docs.dtypes if not t.startswith("map")]))
    rows = twice.groupBy("doc_id", md5).agg(F.min_by(F.struct(*quoted(docs.columns)), least).alias(row))
    rows = written(rows.join(named, (F.col("doc_id") == F.col(id_)) & (F.col(md5) == F.col(m)), "left").select(unit, row))
    every = once.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    every = every.unionByName(rows.where(F.col(unit).isNotNull()).select(F.col(unit).alias("doc_id"), F.col(row)["text"].cast("string").alias("text")))
    gone = written(near_duplicates(every, **params).select("doc_id").distinct())
    kept = without(rows, gone.select(F.col("doc_id").alias(unit)), unit).select(f"{row}.*")
    return without(once, gone).unionByName(kept)


def op3_simhash_near_dedup(spark, sf_dir):
    return near_duplicates(read_table(spark, sf_dir, "documents"))


QUERIES = {"op3_simhash_near_dedup": op3_simhash_near_dedup}
ORACLES: dict[str, str] = {}
