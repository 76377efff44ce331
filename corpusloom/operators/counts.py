"""Word counting, language balance and pair statistics as aggregations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions.pretokens import Pretokenizer, kinds, marked, whole
from corpusloom.operators.ranks import sided
from corpusloom.sources.shared import written

SPECIALS = {"<pad>": 0, "<bos>": 1, "<eos>": 2, "<unk>": 3}


#: Buckets that distinct words are dealt to, and bytes of counts that a task holds before it passes them on.
BUCKETS = 256
HELD = 32 << 20


def _bucket(words: pa.Array) -> np.ndarray:
    """A bucket for each word, by its bytes."""
    off = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset).astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[off[0] : off[-1]].astype(np.uint64)
    size = np.diff(off)
    place = (np.arange(len(data)) - np.repeat(off[:-1] - off[0], size)).astype(np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * (place * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)))])
    off -= off[0]
    return ((total[off[1:]] - total[off[:-1]]) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(56)).astype(np.int16) % BUCKETS


def _summed(tables: list[pa.Table]) -> pa.Table:
    """Each word (of each key) once, with the sum of its counts."""
    t = pa.concat_tables(tables)
    by = t.column_names[:-1]
    return t.group_by(by, use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(t.column_names)


def _dealt(t: pa.Table) -> pa.RecordBatch:
    """A row for each bucket: its number, and its words with their counts."""
    t = t.combine_chunks()
    bucket = np.concatenate([np.zeros(0, np.int16), *map(_bucket, t["word"].chunks)])
    t = t.take(pa.array(np.argsort(bucket, kind="stable"))).combine_chunks()
    cut = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=BUCKETS))]).tolist()
    numbers, held = [], []
    for k in range(BUCKETS):
        if cut[k] < cut[k + 1]:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema) as out:
                out.write_table(t.slice(cut[k], cut[k + 1] - cut[k]))
            numbers.append(k)
            held.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(held, pa.binary())], ["bucket", "held"])


def _counted(kinds: bytes, key: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pretokenizer, held = Pretokenizer(kinds), []
        for b in batches:
            if key is None:
                groups = [(None, b["text"])]
            else:
                found = b[key].dictionary_encode("encode")
                which = found.indices.to_numpy()
                own = np.split(np.argsort(which, kind="stable"), np.cumsum(np.bincount(which))[:-1])
                groups = [(found.dictionary[k : k + 1], b["text"].take(pa.array(rows))) for k, rows in enumerate(own)]
            for name, texts in groups:
                found = pretokenizer(texts)[0].value_counts()
                columns = {"word": marked(found.field("values")).cast(pa.string()), "n": found.field("counts")}
                if key is not None:
                    columns = {key: name.take(pa.array(np.zeros(len(found), np.int64))), **columns}
                held.append(pa.table(columns))
            if sum(t.nbytes for t in held) > HELD:
                held = [_summed(held)]
                if held[0].nbytes > HELD // 2:
                    yield _dealt(held.pop())
        if held:
            yield _dealt(_summed(held))

    return run


def _collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over all that the tasks have dealt to a bucket; a task's buckets come one after the other."""
    last, held = None, []
    for b in batches:
        for number, some in zip(b["bucket"].to_pylist(), b["held"]):
            if number != last and held:
                yield from _summed(held).to_batches()
                held = []
            last = number
            with pa.ipc.open_stream(some.as_buffer()) as t:
                held.append(t.read_all())
    if held:
        yield from _summed(held).to_batches()


def _word_counts(docs: DataFrame, pretokenize: Callable[[Column], Column], *keys: str) -> DataFrame:
    """(*keys, word, freq), with a key at most. The usual pretokens are found and counted by batches of texts, and move in buckets, not row by row."""
    if pretokenize is not tx.pretokens:
        words = docs.select(*keys, F.explode(pretokenize(F.col("text"))).alias("word"), F.lit(1).alias("n"))
        return words.groupBy(*keys, "word").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("freq"))
    rows = docs.select(*keys, whole(F.col("text")).alias("text")).where("text <> ''")
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    dealt = rows.mapInArrow(_counted(kinds(docs.sparkSession), *(keys or (None,))), "bucket int, held binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_collected, f"{schema}word string, n bigint").withColumnRenamed("n", "freq")


def language_words(docs: DataFrame, pretokenize: Callable[[Column], Column] = tx.pretokens) -> DataFrame:
    """(lang, word, freq) of ``docs(lang, text)``; null texts count nothing."""
    return _word_counts(docs, pretokenize, "lang")


def word_frequencies(docs: DataFrame, pretokenize: Callable[[Column], Column] = tx.pretokens) -> DataFrame:
    return _word_counts(docs, pretokenize)


def language_weights(words: DataFrame, alpha: float = 0.5) -> DataFrame:
    """(lang, words, weight): share to the power alpha, renormalized, over the raw share; 0 for a language without words."""
    raw = words.groupBy("lang").agg(F.coalesce(F.sum(F.when(tx.is_word_like(F.col("word")), F.col("freq"))), F.lit(0)).alias("words"))
    every = Window.partitionBy(F.lit(0))  # a row for each language
    c = F.col("words")
    smooth = F.pow(c.cast("double"), F.lit(alpha))
    weight = (smooth / F.sum(smooth).over(every)) / (c / F.sum(c).over(every))
    return raw.select("lang", "words", F.when(c > 0, weight).otherwise(0.0).alias("weight"))


def scaled(freq: Column, weight: Column) -> Column:
    """A count by a weight, ties to the even number, at least 1; nothing for a count that isn't positive."""
    return F.when(freq > 0, F.greatest(F.lit(1), F.rint(freq * weight).cast("bigint")))


def weighted_frequencies(docs: DataFrame, alpha: float = 0.5, boosts: dict[str, float] | None = None, pretokenize: Callable[[Column], Column] = tx.pretokens) -> DataFrame:
    """(word, freq) summed over languages after each one's counts are scaled by its weight and boost."""
    words = written(language_words(docs, pretokenize))  # counted once, for the weights and for what is weighted
    weights = language_weights(words, alpha).select("lang", "weight")
    if boosts:
        boost = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in boosts.items() for x in kv]), F.col("lang")), F.lit(1.0))
        weights = weights.withColumn("weight", F.col("weight") * boost)
    # a row for each language: no language's words are moved to one task
    return words.join(sided(written(weights)), "lang").groupBy("word").agg(F.sum(scaled(F.col("freq"), F.col("weight"))).alias("freq"))


def replicated_frequencies(docs: DataFrame, copies: dict[str, int], pretokenize: Callable[[Column], Column] = tx.pretokens) -> DataFrame:
    """(word, freq) as if each language's texts were there so many times; languages not named are left out. Counts are multiplied, no text is copied."""
    n = F.element_at(F.create_map(*[F.lit(x) for k, v in copies.items() for x in (k, int(v))]), F.col("lang")) if copies else F.lit(None).cast("int")
    words = language_words(docs, pretokenize).withColumn("n", n).where("n > 0")
    return words.groupBy("word").agg(F.sum(F.col("freq") * F.col("n")).alias("freq"))


def base_vocabulary(words: DataFrame, specials: dict[str, int] | None = None) -> DataFrame:
    """(token, id): the special tokens, then the distinct characters in their order; an alphabet fits one task."""
    chars = words.select(F.explode(tx.codepoints(F.col("word"))).alias("token")).distinct()
    specials = SPECIALS if specials is None else specials
    ids = chars.withColumn("id", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("token")) + max(specials.values(), default=-1)).cast("int"))
    return words.sparkSession.createDataFrame(list(specials.items()), "token string, id int").unionByName(ids)


def pair_counts(words: DataFrame, at_least: int = 2) -> DataFrame:
    """(left, right, n): neighbouring characters of all words, overlaps included, by the words' counts."""
    pairs = words.select("freq", F.explode(tx.adjacent_pairs(tx.codepoints(F.col("word")))).alias("p"))
    return pairs.groupBy("p.left", "p.right").agg(F.sum("freq").alias("n")).where(F.col("n") >= at_least)


def best_pairs(pairs: DataFrame, k: int) -> DataFrame:
    return pairs.orderBy(F.desc("n"), "left", "right").limit(k)
