"""Ranks within groups of any size, and joins with a table of Zipf's shape, without a group or a key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.shared import written

#: Rows of a small table that are sent to every task.
BROADCAST_ROWS = 1_000_000


def sided(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (written already) marked for broadcast if its counted rows allow it."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def positions(df: DataFrame, group: str, order: list[str], parts: int | None = None) -> DataFrame:
    """``df`` with ``position`` (from 0) and ``size`` of its group, by the total order of the columns ``order``.

    Rows are parted by range, so that a large group is spread over many parts; each is ranked by itself, from
    the number of the group's rows in the parts before it. The rank is a window's, but no task holds a group.
    """
    parts = parts or df.sparkSession.sparkContext.defaultParallelism * 4
    spread = df.repartitionByRange(parts, group, *order).withColumn("__part", F.spark_partition_id())
    spread = written(spread)
    sizes = spread.groupBy("__part", F.col(group).alias("__group")).agg(F.count("*").alias("__n"))
    by = Window.partitionBy("__group")
    ahead = F.coalesce(F.sum("__n").over(by.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = written(sizes.select(F.col("__part").alias("__p"), "__group", ahead.alias("__ahead"), F.sum("__n").over(by).alias("size")))
    within = F.row_number().over(Window.partitionBy("__part", group).orderBy(*order)) - 1
    ranked = spread.withColumn("__within", within)
    out = ranked.join(sided(sizes), (F.col("__part") == F.col("__p")) & F.col(group).eqNullSafe(F.col("__group")))
    return out.select(*df.columns, (F.col("__ahead") + F.col("__within")).alias("position"), "size")


def ntile(position: Column, size: Column, steps: int) -> Column:
    """The step (from 1) of a position, as SQL deals out rows: the first steps have one more."""
    q, r = F.floor(size / steps), size % steps
    wide = r * (q + 1)
    return (F.when(position < wide, F.floor(position / (q + 1)) + 1).otherwise(r + F.floor((position - wide) / F.greatest(q, F.lit(1))) + 1)).cast("int")


def joined_by_frequency(rows: DataFrame, model: DataFrame, key: str, weight: str, limit: int = BROADCAST_ROWS, hot: int = 100_000) -> DataFrame:
    """``rows`` joined with ``model`` on ``key``: the ``hot`` keys of the greatest ``weight`` by broadcast, the rest by shuffle.

    Keys that many rows have are never sent to one task. A model of at most ``limit`` rows is broadcast whole.
    """
    model = written(model)
    if model.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(model), key)
    top = written(model.orderBy(F.desc(weight), key).limit(hot))
    rest = model.join(F.broadcast(top.select(key)), key, "left_anti")
    return rows.join(F.broadcast(top), key).unionByName(rows.join(F.broadcast(top.select(key)), key, "left_anti").join(rest, key))
