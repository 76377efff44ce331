"""Words are counted whatever a task holds and however they are dealt to buckets; a merge looks only at the places of its own pair."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import bpe, counts
from test_pretokens import texts


@pytest.mark.parametrize("held", [0, 1 << 12, 32 << 20])
def test_counts_of_tasks_that_hold_little(spark, monkeypatch, held):
    rows = [(lang, t) for lang, t in zip(["en", "de", None] * 900, texts(1200))]
    monkeypatch.setattr(counts, "HELD", held)
    kinds = counts.kinds(spark)
    batches = pa.table({"lang": [x for x, _ in rows], "text": [t or "" for _, t in rows]}).to_batches(max_chunksize=100)
    dealt = list(counts._counted(kinds, "lang")(iter(batches)))
    assert (len(dealt) > 1) == (held < 1 << 20)
    one = sorted((k, h) for b in dealt for k, h in zip(b["bucket"].to_pylist(), b["held"].to_pylist()))
    one = pa.RecordBatch.from_arrays([pa.array([k for k, _ in one], pa.int32()), pa.array([h for _, h in one], pa.binary())], ["bucket", "held"])
    got = [tuple(r.values()) for b in counts._collected(iter([one[:7], one[7:]])) for r in b.to_pylist()]
    docs = spark.createDataFrame(rows, "lang string, text string")
    plain = docs.select("lang", F.explode(tx.pretokens(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    assert sorted(got, key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_words_move_in_buckets(spark):
    docs = spark.createDataFrame([("en", t) for t in texts(300)], "lang string, text string")
    plan = counts.language_words(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("MapInArrow") == 2
    words = pa.array([f"w{k}é" for k in range(5000)])
    bucket = counts._bucket(words)
    assert bucket.tolist()[10:20] == counts._bucket(words[10:20]).tolist()
    assert set(bucket.tolist()) == set(range(counts.BUCKETS)) and max(bpe.np.bincount(bucket)) < 60


def test_merges_look_at_their_pair_only():
    rng = random.Random(5)
    np = bpe.np
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    places = bpe.Places(pa.array(words), np.ones(400, np.int64), np.array([ord(c) for c in "abcdefgh"], np.uint32))
    numbers, result = {c: i for i, c in enumerate("abcdefgh")}, 8
    now, looked, there = [[numbers[c] for c in w] for w in words], [], []
    real = places.symbol.take
    for _ in range(60):
        count = {}
        for w in now:
            for p in zip(w, w[1:]):
                count[p] = count.get(p, 0) + 1
        a, b = max(count, key=lambda p: (count[p], p))
        at = places.of(a, b)
        assert len(np.unique(at)) == count[a, b]
        assert (real(at) == a).all() and (real(places.after.take(at)) == b).all()
        looked.append(len(at))
        there.append(min(int((places.symbol == x).sum()) for x in (a, b)))
        places.merge(a, b, result)
        out = []
        for w in now:
            i, s = 0, []
            while i < len(w):
                hit = i + 1 < len(w) and (w[i], w[i + 1]) == (a, b)
                s.append(result if hit else w[i])
                i += 1 + hit
            out.append(s)
        now, result = out, result + 1
        assert places.symbol[places.symbol >= 0].tolist() == [x for w in now for x in w]
    assert sum(looked) < sum(there) / 2  # a merge that looks at all places of its rarer symbol looks at all of these
