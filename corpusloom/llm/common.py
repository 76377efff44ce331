"""What the operators share: tables in the shared folder and size checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.components import LOCAL_EDGES, components, dropped, union_find  # noqa: F401
from corpusloom.sources.shared import written  # noqa: F401
from corpusloom.sources.tables import BATCH, bounded_batches, table  # noqa: F401

#: Id lists up to this many rows are sent to every executor (8 bytes each); larger ones are shuffled.
BROADCAST_IDS = 2_000_000


def quoted(columns: list[str]) -> list[str]:
    """Column names that may hold dots or backticks, as Spark resolves them."""
    return ["`" + c.replace("`", "``") + "`" for c in columns]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, changed where ``df`` has columns of these names already."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return table(spark, sf_dir, name)


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id", broadcast_rows: int = BROADCAST_IDS) -> DataFrame:
    """Rows of ``docs`` whose ``key`` isn't in ``ids`` (one bigint column ``key``, already written).

    The id list is broadcast while its counted size allows; beyond, both sides are shuffled on the key and
    the id side is hashed, so long texts are never sorted. Rows with a null key stay.
    """
    n = ids.count()
    if n == 0:
        return docs
    (other,) = fresh(docs, "__loom_key")
    side = ids.select(F.col(key).alias(other))
    side = F.broadcast(side) if n <= broadcast_rows else side.hint("shuffle_hash")
    return docs.join(side, docs[key] == side[other], "left_anti")
