"""Streams over the same expressions (an extension: the batch queries need none)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx


def windowed_words(stream: DataFrame, size: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Words of ``stream(ts, lang, text)`` by language and window; rows later than the watermark are dropped."""
    words = F.size(F.filter(tx.pretokens(F.col("text")), tx.is_word_like))
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size), "lang").agg(F.sum(words).alias("words"), F.count("*").alias("docs"))
