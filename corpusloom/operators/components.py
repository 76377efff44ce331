"""Connected components of an edge list."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.shared import written

#: Edge lists up to this many rows are joined into components by one task; larger ones by iterated joins.
LOCAL_EDGES = 2_000_000


def dropped(df: DataFrame) -> None:
    """Deletes a table made by a ``written`` that no later plan reads."""
    spark = df.sparkSession
    for f in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f.rsplit("/", 1)[0])
        if "/loom-" in folder.toString() or "/table-" in folder.toString():
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges ``a[i]-b[i]`` with the least node of their component."""
    nodes, idx = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = idx[: len(a)], idx[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _one_task(batch: pa.Table) -> pa.Table:
    node, comp = union_find(batch["a"].to_numpy(), batch["b"].to_numpy())
    return pa.table({"node": pa.array(node, pa.int64()), "comp": pa.array(comp, pa.int64())})


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, comp) for each node of the undirected ``edges(a, b)``; comp is the least node it is connected to.

    A counted list of at most ``local_edges`` goes to one task. A longer one is contracted by alternating
    large-star and small-star joins, each round written to the shared folder, until nothing changes; both
    ways give the same rows.
    """
    edges = written(edges.select("a", "b").where("a <> b").distinct())
    if edges.count() <= local_edges:
        return edges.withColumn("g", F.lit(0)).groupBy("g").applyInArrow(_one_task, "node bigint, comp bigint")

    def signature(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b") % 1_000_000_007), F.lit(0))).first())

    def star(df: DataFrame, large: bool) -> DataFrame:
        both = df.select("a", "b").union(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:
            both = df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        moved = both.join(low, "a")
        if large:
            out = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        return written(out.where("a <> b").distinct())

    before = None
    while True:
        new = star(star(edges, True), False)
        after = signature(new)
        dropped(edges)
        edges = new
        if after == before:
            break
        before = after
    stars = edges.groupBy("a").agg(F.min("b").alias("comp")).select(F.col("a").alias("node"), "comp")
    return stars.union(stars.select(F.col("comp").alias("node"), "comp").distinct())
