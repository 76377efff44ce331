"""MinHash links between contents against all pairs."""

from itertools import combinations

from corpusloom.operators.components import union_find
from corpusloom.plans import curation_plans


def test_links_are_those_of_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").union(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(5).selectExpr("doc_id + 1000000", "* EXCEPT (doc_id)"))
    shingled = curation_plans.near_shingles(docs)
    s = {r.doc_id: frozenset(r.s) for r in shingled.collect()}
    name = {}
    for i in sorted(s):
        name.setdefault(s[i], i)
    index = {(a, b): round(len(s[a] & s[b]) / len(s[a] | s[b]), 6) for a, b in combinations(sorted(name.values()), 2)}
    want = {p: j for p, j in index.items() if j >= 0.7}
    import numpy as np

    edges = [*want, *((name[x], i) for i, x in s.items() if name[x] != i)]
    node, comp = union_find(*(np.array(c) for c in zip(*edges)))
    group = dict(zip(node.tolist(), comp.tolist()))
    for block in (1000, 1):
        pairs, rows = curation_plans.minhash_links(shingled, block=block)
        got = {(r.a, r.b): r.jaccard for r in pairs.collect()}
        assert got.items() <= want.items() and len(got) >= 0.97 * len(want)
        rows = {r.doc_id: r for r in rows.collect()}
        assert rows.keys() == s.keys()
        if len(got) == len(want):
            for i, r in rows.items():
                links = sum(name[s[i]] in p for p in want)
                assert (r.content, r.copies, r.links, r.comp) == (name[s[i]], sum(x == s[i] for x in s.values()), links, group.get(i, i))


def test_every_pair_of_a_bucket_is_compared(spark):
    # 1 shares a shingle with all, but is near none; 2 to 6 are near each other; 7 is a copy of 6
    rows = [(1, [5, *range(100, 109)])] + [(i, [*range(1, 40), 1000 + i]) for i in range(2, 7)] + [(7, [1006, *range(39, 0, -1)])]
    df = spark.createDataFrame(rows, "doc_id bigint, s array<bigint>")
    for block in (1000, 2):
        pairs, docs = curation_plans.minhash_links(df, bands=64, rows=1, block=block)
        assert sorted((r.a, r.b, r.comp) for r in pairs.collect()) == [(a, b, 2) for a, b in combinations(range(2, 7), 2)]
        assert sorted(tuple(r) for r in docs.collect()) == [(1, 1, 1, 0, 1), *((i, i, 1, 4, 2) for i in range(2, 6)), (6, 6, 2, 4, 2), (7, 6, 2, 4, 2)]


def test_no_documents(spark):
    for df in curation_plans.minhash_links(spark.createDataFrame([], "doc_id bigint, s array<bigint>")):
        assert df.count() == 0


def test_sets_are_signed_together():
    import hashlib
    import time

    import numpy as np
    import pyarrow as pa

    from corpusloom.operators import minhash

    rng = np.random.default_rng(3)
    sets = [rng.integers(-(1 << 63), 1 << 63, n).tolist() for n in (1, 5, 0, 20_000, 2, 40_000, *rng.integers(1, 300, 60))]
    sets[2:2] = [None]
    got = minhash.signed(4, 3).func(pa.array(sets, pa.list_(pa.int64()))).to_pylist()
    assert minhash.signed(4, 3).func(pa.array([None, []], pa.list_(pa.int64()))).to_pylist() == [{"keys": None, "content": None}] * 2
    for s, g in zip(sets, got):
        if not s:
            assert g == {"keys": None, "content": None}
            continue
        h = np.sort(np.array(s)).view(np.uint64)
        key = np.zeros(4, np.uint64)
        for b in range(4):
            for r in range(3):
                least = minhash.mixed(h + np.uint64(0x9E3779B97F4A7C15 * (b * 3 + r + 1) & (1 << 64) - 1)).min()
                key[b] = minhash.mixed(np.array([key[b] ^ least], np.uint64) + np.uint64(b + 1))[0]
        assert g == {"keys": key.view(np.int64).tolist(), "content": hashlib.blake2b(h.tobytes(), digest_size=16).digest()}
    many = pa.array([[i, i + 1, i + 2] for i in range(20_000)], pa.list_(pa.int64()))
    began = time.process_time()
    minhash.signed(16, 3).func(many)
    assert time.process_time() - began < 4  # about 10 s where each set is hashed by itself


def test_shingles_are_sparks_hashes(spark):
    import random

    from pyspark.sql import functions as F

    from corpusloom.operators import minhash

    rng = random.Random(6)
    texts = ["", None, "x", "a b c d", "a b c d e", "a b a b a b a b a b a b", "É ß 漢字 𝄞 k " * 3, "?! .", "w" * 5000 + " b c d e f"]
    texts += [" ".join("".join(rng.choice("abé漢A1") for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 40))) + "!" for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - 4))
    want = df.select("doc_id", words.alias("w")).where("size(w) > 0").select("doc_id", F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice("w", i, 5), " ")))).alias("s"))
    want = {r.doc_id: sorted(r.s) for r in want.collect()}
    got = curation_plans.near_shingles(df)
    assert "transform" not in got._jdf.queryExecution().toString()  # no text is made of each run by an interpreted function
    assert {r.doc_id: sorted(r.s) for r in got.collect()} == want and len(want) > 80
    assert df.limit(2).select(minhash.shingles(5)(F.col("text")).alias("s")).collect()[0].s == []
