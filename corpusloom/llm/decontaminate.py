"""Benchmark decontamination by winnowing.

Of every window of ``window`` successive k-grams of words the one with the least hash (the rightmost of
ties) is a fingerprint. A span of at least ``k + window - 1`` words that a document shares with a benchmark
item therefore shares a fingerprint. Hits are extended both ways to the longest equal run of words, and runs
of that guaranteed length are reported. An item of fewer words, from ``short`` on, is compared whole: all runs of as many words
of a document are looked up. Words are compared in lower case, without punctuation.

The benchmark's fingerprints and words go to every executor while their counted size allows it, and the
documents are read once, with no shuffle. A larger benchmark is joined by shuffle on the fingerprint, after a filter of
fixed size has taken away the fingerprints that no item has. Both ways give the same rows.

Defined results: null texts on either side and null item ids take no part. An item is an id with a text, so one
id may have several texts. Rows with a null doc_id have no spans, but ``clean`` judges every row by its own text, whatever its id:
equal texts go or stay together, and another row of the same id stays. Equal spans of one doc_id and item_id are reported once. Items
of fewer than ``short`` words are not looked for: so few words occur anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import BROADCAST_IDS, fresh, read_table, written
from corpusloom.llm.words import as_texts, chunks, grams, mix, words

K = 8
WINDOW = 6
#: Benchmarks up to this many words are broadcast (about 24 bytes a word).
BROADCAST_WORDS = 5_000_000
#: The least words of an item.
SHORT = 5
#: Bits of the filter by which fingerprints are sent to a join (16 MB).
FILTER_BITS = 27
SPAN = "doc_id bigint, item_id bigint, doc_word bigint, item_word bigint, n_words bigint, item_words bigint"


def winnow(g: np.ndarray, count: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """Indices of the grams that are the least of some window; windows never leave a text."""
    doc = np.repeat(np.arange(len(count)), count)
    local = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = first[:-1][doc] + local
    h, n = g[at], len(at)
    size = count[doc]
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    ok = np.ones(n, bool)
    for d in range(1, window):
        ok[:d] = False
        ok[d:] &= (local[d:] >= d) & (h[d:] <= h[:-d])
        left += ok
    ok = np.ones(n, bool)
    for d in range(1, window):
        ok[n - d if n > d else 0 :] = False
        if n > d:
            ok[:-d] &= (local[:-d] + d < size[:-d]) & (h[:-d] < h[d:])
        right += ok
    return at[left + right + 1 >= np.minimum(window, size)]


def _whole(w, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, told apart from those of other lengths, and the index of the first word of each."""
    g, count = grams(w, k)
    doc = np.repeat(np.arange(len(count)), count)
    at = w.first[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return mix(g[at] ^ np.uint64(k)), at


def _prints(key: str, kind: pa.DataType, k: int, window: int, lengths: tuple[int, ...] | None, bits: np.ndarray | None = None, short: int = SHORT):
    """(key, fp, at) of the winnowed fingerprints and of the runs of ``lengths`` words; of items (``lengths`` None) the short ones whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, i, j in ((b, i, j) for b in batches for i, j in chunks(as_texts(b["text"]))):
            b = whole.slice(i, j - i)
            w = words(b["text"])
            least = k + window - 1
            g, count = grams(w, k)
            at = winnow(g, count, w.first, window)
            if lengths is None:
                at = at[np.diff(w.first)[np.searchsorted(w.first, at, "right") - 1] >= least]
            parts = [(g[at], at)]
            for n in range(short, least) if lengths is None else lengths:
                h, first = _whole(w, n)
                if lengths is None:
                    own = np.diff(w.first)[np.searchsorted(w.first, first, "right") - 1] == n
                    h, first = h[own], first[own]
                parts.append((h, first))
            fp, at = (np.concatenate(x) for x in zip(*parts))
            if bits is not None:
                place = fp >> np.uint64(64 - FILTER_BITS)
                keep = (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
                fp, at = fp[keep], at[keep]
            doc = np.searchsorted(w.first, at, "right") - 1
            yield pa.RecordBatch.from_arrays([b[key].cast(kind).take(pa.array(doc)), pa.array(fp.view(np.int64)), pa.array(at - w.first[doc])], [key, "fp", "at"])

    return run


def _rows(df: DataFrame, key: str) -> DataFrame:
    rows = df.select(F.col(key).cast("bigint").alias(key), F.col("text").cast("string").alias("text"))
    return rows.where(F.col(key).isNotNull() & F.col("text").isNotNull())


def _items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, text): the distinct items by a hash of id and text."""
    return _rows(benchmark, "item_id").distinct().withColumn("item", F.md5(F.concat_ws(":", "item_id", "text")))


def item_prints(items: DataFrame, k: int = K, window: int = WINDOW, short: int = SHORT) -> DataFrame:
    return items.select("item", "text").mapInArrow(_prints("item", pa.string(), k, window, None, short=short), "item string, fp bigint, at bigint")


def _filter(prints: DataFrame) -> np.ndarray:
    """The bits of the filter: of a fixed size, whatever the benchmark's."""
    place = F.shiftrightunsigned(F.col("fp"), 64 - FILTER_BITS)
    bits = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    packed = prints.select(place.alias("p")).groupBy(F.bitmap_bucket_number(F.col("p") + 1).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("p") + 1)).alias("bits"))
    for r in packed.toLocalIterator():
        got = np.frombuffer(bytes(r["bits"]), np.uint8)
        lo = (r["k"] - 1) * len(got)
        bits[lo : lo + len(got)] = got
    return bits


@dataclass
class Index:
    """Benchmark items for probing: fingerprints in order, their places, and the items' word hashes."""

    fp: np.ndarray
    item: np.ndarray
    at: np.ndarray
    ids: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    lengths: tuple[int, ...]


def index(texts: pa.Array, ids: np.ndarray, k: int, window: int, short: int = SHORT) -> Index:
    w = words(texts)
    g, count = grams(w, k)
    at = winnow(g, count, w.first, window)
    size = np.diff(w.first)
    item = np.searchsorted(w.first, at, "right") - 1
    at = at[size[item] >= k + window - 1]
    fp = g[at]
    lengths = tuple(n for n in range(short, k + window - 1) if (size == n).any())
    for n in lengths:
        h, first = _whole(w, n)
        own = size[np.searchsorted(w.first, first, "right") - 1] == n
        fp, at = np.concatenate([fp, h[own]]), np.concatenate([at, first[own]])
    item = np.searchsorted(w.first, at, "right") - 1
    order = np.argsort(fp, kind="stable")
    return Index(fp[order], item[order], (at - w.first[item])[order], ids, w.first, w.hash, lengths)


def extended(doc: np.ndarray, at: int, item: np.ndarray, iat: int) -> tuple[int, int, int]:
    """The longest run of equal words through doc[at] and item[iat]: its starts and length."""
    back = min(at, iat)
    ahead = min(len(doc) - at, len(item) - iat)
    same = doc[at - back : at + ahead] == item[iat - back : iat + ahead]
    miss = np.flatnonzero(~same)
    p = int(np.searchsorted(miss, back))
    lo = int(miss[p - 1]) + 1 if p else 0
    hi = int(miss[p]) if p < len(miss) else len(same)
    return at - back + lo, iat - back + lo, hi - lo


def spans(doc: np.ndarray, hits: Iterator[tuple[int, int, int]], words_of, least: int) -> set[tuple[int, int, int, int, int]]:
    """(item, doc start, item start, length, item length) of the runs through the hits (at, item, item's at)."""
    out, done = set(), {}
    for at, item, iat in sorted(hits, key=lambda h: (h[1], h[0] - h[2], h[0])):
        if done.get((item, at - iat), -1) > at:
            continue
        text = words_of(item)
        a, b, n = extended(doc, at, text, iat)
        done[(item, at - iat)] = a + n
        if n >= min(least, len(text)) and (doc[at] == text[iat]):
            out.add((item, a, b, n, len(text)))
    return out


def _hits(ix: Index, texts: pa.Array, k: int, window: int, table: np.ndarray):
    """For each text that has any: its row and its spans."""
    texts = as_texts(texts)
    for i, j in chunks(texts):
        for d, found in _chunk_hits(ix, texts.slice(i, j - i), k, window, table):
            yield i + d, found


def _chunk_hits(ix: Index, texts: pa.Array, k: int, window: int, table: np.ndarray):
    w = words(texts)
    g, count = grams(w, k)
    if not len(w.hash) or not len(ix.fp):
        return
    at = winnow(g, count, w.first, window)
    parts = []
    for fp, first in ((g[at], at), *(_whole(w, n) for n in ix.lengths)):
        keep = table[(fp >> np.uint64(44)).astype(np.int64)]
        parts.append((fp[keep], first[keep]))
    fp, at = (np.concatenate(x) for x in zip(*parts))
    lo, hi = np.searchsorted(ix.fp, fp), np.searchsorted(ix.fp, fp, "right")
    at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
    doc = np.searchsorted(w.first, at, "right") - 1
    for d in np.unique(doc):
        mine = np.flatnonzero(doc == d)
        begin = w.first[d]
        hits = [(int(at[m] - begin), int(ix.item[j]), int(ix.at[j])) for m in mine for j in range(lo[m], hi[m])]
        found = spans(w.hash[begin : w.first[d + 1]], hits, lambda i: ix.hash[ix.first[i] : ix.first[i + 1]], k + window - 1)
        if found:
            yield int(d), found


def _table(ix: Index) -> np.ndarray:
    table = np.zeros(1 << 20, bool)
    table[(ix.fp >> np.uint64(44)).astype(np.int64)] = True
    return table


def _probe(ix: Index, k: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(ix)
        for b in batches:
            ids = b["doc_id"].to_numpy(zero_copy_only=False)
            rows = [
                (int(ids[d]), int(ix.ids[i]), a, c, n, m)
                for d, found in _hits(ix, b["text"], k, window, table)
                for i, a, c, n, m in sorted(found)
            ]
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [c.split()[0] for c in SPAN.split(", ")])

    return run


def _small_index(benchmark: DataFrame, k: int, window: int, limit: int, short: int) -> Index | None:
    """The index, if the benchmark has at most ``limit`` words by count."""
    rows = _rows(benchmark, "item_id")
    size = rows.agg(F.coalesce(F.sum(F.size(F.split("text", "[^0-9A-Za-z\u0080-\U0010ffff]+"))), F.lit(0))).first()[0]
    if size > limit:
        return None
    t = rows.distinct().orderBy("item_id", "text").toArrow()
    return index(t["text"].combine_chunks() if t.num_rows else pa.array([], pa.string()), t["item_id"].to_numpy(), k, window, short)


def contaminated_spans(
    docs: DataFrame, benchmark: DataFrame, k: int = K, window: int = WINDOW, broadcast_words: int = BROADCAST_WORDS, short: int = SHORT
) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, n_words, item_words) of every shared span."""
    ix = _small_index(benchmark, k, window, broadcast_words, short)
    if ix is not None:
        return _rows(docs, "doc_id").mapInArrow(_probe(ix, k, window), SPAN).distinct()
    found = written(_joined_spans(_rows(docs, "doc_id"), benchmark, k, window, short))
    ids = _rows(docs, "doc_id").select("doc_id", F.md5("text").alias("key"))
    return ids.join(found, "key").drop("key").distinct()


def _joined_spans(rows: DataFrame, benchmark: DataFrame, k: int, window: int, short: int) -> DataFrame:
    """(key, item_id, doc_word, ...): the spans of each distinct text of ``rows(text)``, named by its MD5, through a join on the fingerprint."""
    items = written(_items(benchmark))
    prints = written(item_prints(items, k, window, short))
    size = F.size(F.filter(F.split(F.lower("text"), "[^0-9a-z\u0080-\U0010ffff]+"), lambda x: x != ""))
    lengths = tuple(sorted(r["n"] for r in items.select(size.alias("n")).where(f"n BETWEEN {short} AND {k + window - 2}").distinct().collect()))
    texts = rows.select(F.md5("text").alias("key"), "text")
    mine = texts.mapInArrow(_prints("key", pa.string(), k, window, lengths, _filter(prints)), "key string, fp bigint, at bigint")
    # copies of a text bring the same rows; a text meets an item once, with all their hits
    hits = mine.join(prints.select("item", "fp", F.col("at").alias("iat")), "fp").groupBy("key", "item").agg(F.collect_set(F.struct("at", "iat")).alias("hits"))
    hits = written(hits)
    both = hits.join(items.select("item", "item_id", F.col("text").alias("item_text")), "item").select("key", "item_id", "item_text", "hits")
    text = texts.join(hits.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    least = k + window - 1
    names = [c.split()[0] for c in SPAN.split(", ")][1:]

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        out = set()
        key = left["key"][0].as_py() if len(left) else None
        doc = words(pa.array([left["text"][0].as_py()])).hash if len(left) else None
        for item_id, item_text, pairs in zip(*(right[c].to_pylist() for c in ("item_id", "item_text", "hits"))) if len(left) else ():
            item = words(pa.array([item_text])).hash
            found = spans(doc, [(x["at"], 0, x["iat"]) for x in pairs], lambda _: item, least)
            out |= {(item_id, *f[1:]) for f in found}
        cols = list(zip(*sorted(out))) if out else [[]] * len(names)
        return pa.table({"key": pa.array([key] * len(out), pa.string())} | {n: pa.array(v, pa.int64()) for n, v in zip(names, cols)})

    return text.groupBy("key").cogroup(both.groupBy("key")).applyInArrow(solve, "key string, " + SPAN.split(", ", 1)[1])


def clean(docs: DataFrame, benchmark: DataFrame, k: int = K, window: int = WINDOW, broadcast_words: int = BROADCAST_WORDS, short: int = SHORT) -> DataFrame:
    """The rows of ``docs`` that share no span with the benchmark, all columns as they were; each row is judged by its text."""
    ix = _small_index(benchmark, k, window, broadcast_words, short)
    text = F.col("text").cast("string")
    if ix is None:
        gone = written(_joined_spans(docs.select(text.alias("text")).where("text IS NOT NULL"), benchmark, k, window, short).select("key").distinct())
        (key,) = fresh(docs, "__loom_key")
        side = gone.select(F.col("key").alias(key))
        side = F.broadcast(side) if gone.count() <= BROADCAST_IDS else side.hint("shuffle_hash")
        return docs.join(side, F.md5(text) == F.col(key), "left_anti")

    @F.arrow_udf("boolean")
    def hit(text: pa.Array) -> pa.Array:
        out = np.zeros(len(text), bool)
        for d, _ in _hits(ix, text, k, window, _table(ix)):
            out[d] = True
        return pa.array(out)

    return docs.where(~hit(text))


def op7_decontaminate(spark, sf_dir):
    return contaminated_spans(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {"op7_decontaminate": op7_decontaminate}
ORACLES = {
    "op7_decontaminate": """
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[0-9a-z\\x{80}-\\x{10ffff}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
b AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[0-9a-z\\x{80}-\\x{10ffff}]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
dp AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
bp AS (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS p FROM b),
dg AS (SELECT doc_id, p, array_to_string(w[p:p+12], ' ') AS g FROM dp WHERE p + 12 <= len(w)),
bg AS (SELECT item_id, len(w) AS m, p, array_to_string(w[p:p+12], ' ') AS g FROM bp WHERE p + 12 <= len(w)),
hit AS (SELECT doc_id, item_id, m, dg.p AS dp, bg.p AS ip, dg.p - bg.p AS diag FROM dg JOIN bg USING (g)),
isl AS (SELECT *, dp - row_number() OVER (PARTITION BY doc_id, item_id, m, diag ORDER BY dp) AS isle FROM (SELECT DISTINCT * FROM hit))
SELECT doc_id, item_id, min(dp) - 1 AS doc_word, min(ip) - 1 AS item_word, max(dp) - min(dp) + 13 AS n_words, any_value(m) AS item_words
FROM isl GROUP BY doc_id, item_id, m, diag, isle
UNION SELECT doc_id, item_id, p - 1, 0, len(b.w), len(b.w) FROM dp JOIN b ON dp.w[p:p + len(b.w) - 1] = b.w WHERE len(b.w) BETWEEN 5 AND 12"""
}
