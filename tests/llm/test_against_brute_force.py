"""Each operator against a plain version of it."""

import base64
import gzip
import random
import re
import urllib.parse
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from corpusloom.llm import common, decontaminate, embedding_dedup, licenses, mixing, pii, quality, secrets, simhash_dedup, tokens, toxicity, words

D = "/root/testdata/sf0.001"
TOKEN = "ghp_" + "aB3dE6gH9jK2mN5pQ8sT1vW4yZ7bC0eF3hI6"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


@pytest.fixture(scope="module")
def frame():
    return pd.read_parquet(f"{D}/documents.parquet")


def test_words_are_the_regular_expression(frame):
    texts = [*frame.text, "", "É1-x", "a" * 50, " x y"]
    w = words.words(pa.array(texts))
    for i, t in enumerate(texts):
        found = [bytes(w.buf[a:b]).decode() for a, b in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]])]
        assert found == words.WORD.findall(t.lower())


def test_spans_are_disjoint():
    s = words.Spans()
    assert [s.take(*x) for x in [(5, 8), (7, 9), (8, 9), (0, 6), (0, 5)]] == [True, False, True, False, True]


def test_union_find_and_joins_agree(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    one = {tuple(r) for r in common.components(df).collect()}
    assert one == {tuple(r) for r in common.components(df, local_edges=0).collect()}


# 1: secrets
@pytest.mark.parametrize(
    "wrap, layers",
    [
        (lambda s: s, ""),
        (lambda s: base64.b64encode(s.encode()).decode(), "base64"),
        (lambda s: base64.b64encode(base64.b64encode(s.encode())).decode(), "base64/base64"),
        (lambda s: base64.b64encode(gzip.compress(s.encode())).decode(), "base64/gzip"),
        (lambda s: "".join(f"\\u{ord(c):04x}" for c in s), "unicode"),
        (lambda s: "".join(f"%{b:02x}" for b in base64.b64encode(s.encode())), "url/base64"),
        (lambda s: urllib.parse.quote(base64.b64encode(s.encode() + b"??>>").decode(), safe=""), "base64"),
        (lambda s: s.encode().hex(), "hex"),
    ],
)
def test_secret_layers(wrap, layers):
    inner = wrap(TOKEN)
    text = f"before {inner} after"
    found = [f for f in secrets.findings(text) if f[0] == "github_token"]
    assert len(found) == 1 and found[0][1] == TOKEN and found[0][4].startswith(layers)
    a, b = found[0][2:4]
    assert 7 <= a < b <= 7 + len(inner)


def test_secret_scan_finds_the_plain_ones(spark, docs, frame):
    plain = re.compile(r'(?:token|secret|password|api_key) ?= ?"([A-Za-z0-9+/_-]{16,})"|(AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36})', re.I)
    want = {(int(d), m[1] or m[2]) for d, t in zip(frame.doc_id, frame.text) for m in plain.finditer(t)}
    got = {(r.doc_id, r.secret) for r in secrets.secrets(docs).collect()}
    assert want <= got


def test_bombs_are_reported():
    bomb = base64.b64encode(gzip.compress(b"a" * 5000)).decode()
    assert [f[0] for f in secrets.findings(f"x {bomb} y", max_bytes=1000)] == ["oversized"]


# 2: licenses
def test_templates_find_themselves():
    for name, forms in licenses.TEMPLATES.items():
        for form, text in forms.items():
            found = licenses.findings("Some words come first, of no interest.\n" + text)
            assert found, (name, form)
            assert [f[2] for f in found] == [name], (name, form, found)


def test_changed_wording_is_listed():
    text = licenses.TEMPLATES["MIT"]["text"].replace("free of charge", "at no cost")
    found = licenses.findings(text)[0]
    assert found[2] == "MIT" and {"no", "cost"} & set(found[6]) and "charge" in found[7]


# 3: near-duplicates
def test_simhash_pairs(frame):
    fp = simhash_dedup.fingerprint(pa.array(frame.text))
    one = np.concatenate([simhash_dedup.fingerprint(pa.array([t])) for t in frame.text])
    assert (fp == one).all()


def test_simhash_finds_what_brute_force_finds(spark, docs, frame):
    fp = simhash_dedup.fingerprint(pa.array(frame.text))
    near = np.bitwise_count(fp[:, None, :] ^ fp[None, :, :]).sum(axis=2) <= 40
    a, b = np.nonzero(np.triu(near, 1))
    ids = frame.doc_id.to_numpy()
    node, comp = common.union_find(ids[a], ids[b])
    want = {(int(c), int(n)) for n, c in zip(node, comp) if n != c}
    got = {(r.rep_id, r.doc_id) for r in simhash_dedup.near_duplicates(docs).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)
    assert {(r.rep_id, r.doc_id) for r in simhash_dedup.near_duplicates(docs, cap=2).collect()} <= want


# 4: tokens
def test_round_trip_and_random_access(spark, docs, frame):
    rows = tokens.encoded(docs, shard_tokens=20_000, min_count=8).collect()
    enc = tokens.encoding(tokens.VOCABULARY)
    rules = {r.shard: r for r in rows if r.rules is not None}
    texts = dict(zip(frame.doc_id, frame.text))
    assert any(len(r.rules) for r in rules.values())
    for r in (r for r in rows if r.rules is None):
        pairs, lengths = tokens.unpack_rules(rules[r.shard].rules, r.width), tokens.unpack_lengths(rules[r.shard].lengths)
        codes = tokens.unpack(r.codes, r.width)
        ids = tokens.decode_ids(codes, pairs, lengths, enc.n_vocab)
        assert ids.tolist() == enc.encode(texts[r.doc_id], disallowed_special=())
        assert tokens.decode_ids(codes, pairs, lengths, enc.n_vocab, 5, 17).tolist() == ids[5:17].tolist()


def test_pieces_are_the_pattern():
    texts = ["don't  stop\n\n now 12ab ç", " 'll x's", "a b  c", "", "  ", "'s" * 3, "l'été d'un 'tis"]
    enc = tokens.encoding(tokens.VOCABULARY)
    got = list(tokens.Encoder(tokens.VOCABULARY)(pa.array(texts)))
    assert [g.tolist() for g in got] == [enc.encode(t) for t in texts]


# 5: quality
def test_held_out_accuracy(spark, docs):
    big = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{big}/labels.parquet")
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1").toPandas().set_index("doc_id").quality
    kept = {r.doc_id for r in quality.accepted(spark.read.parquet(f"{big}/documents.parquet"), train).select("doc_id").collect()}
    right = [(i in kept) == bool(q) for i, q in test.items()]
    assert np.mean(right) > 0.95


def test_stage_and_query_agree(spark, docs):
    labels = spark.read.parquet(f"{D}/labels.parquet")
    kept = {r.doc_id for r in quality.accepted(docs, labels).collect()}
    assert kept == {r.doc_id for r in quality.scores(docs, labels).where("posterior >= 0.5").collect()}
    assert kept == {r.doc_id for r in quality.accepted(docs, labels, broadcast_sites=0).collect()}


def test_sparse_sites_shrink(spark):
    rows = [("a", "p", 3.0)] * 200 + [("a", "q", -3.0)] + [("b", "p", -3.0)] * 200 + [("c", "p", -3.0)]
    sites, mu = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, z double"))
    post = {(r.host, r.path): r.path_post for r in sites.collect()}
    assert post["b", "p"] < post["c", "p"] < mu and post["a", "q"] < post["a", "p"]


# 6: personal data
@pytest.mark.parametrize(
    "text, kind, value",
    [
        ("write to ann.lee@example.org now", "email", "ann.lee@example.org"),
        ("write to ann [at] example [dot] org now", "email", "ann@example.org"),
        ("mail аnn@exаmple.org", "email", "ann@example.org"),
        ("call five five five zero one nine nine", "phone", "5550199"),
        ("card 4111 1111 1111 1111 ok", "card", "4111 1111 1111 1111"),
        ("ip １０.0.0.7 x", "ip", "10.0.0.7"),
        ("call +1 (826) 555-4081 190.137.223.20", "phone", "+1 (826) 555-4081"),
    ],
)
def test_disguises(text, kind, value):
    found = [f for f in pii.findings("éa " + text) if f[0] == kind]
    assert [f[1] for f in found] == [value]
    a, b = found[0][2:4]
    assert pii.findings(("éa " + text)[a:b])[0][1] == value


def test_plain_text_has_none():
    assert pii.findings("Meet at noon dot on the 12th of May 2021, at room 101.") == []


# 7: decontamination
def test_ways_agree_and_spans_are_guaranteed(spark, docs, frame):
    bench = spark.read.parquet(f"{D}/benchmark.parquet")
    one = {tuple(r) for r in decontaminate.contaminated_spans(docs, bench).collect()}
    assert one == {tuple(r) for r in decontaminate.contaminated_spans(docs, bench, broadcast_words=0).collect()}
    items = {int(i): words.WORD.findall(t.lower()) for i, t in zip(*pd.read_parquet(f"{D}/benchmark.parquet")[["item_id", "text"]].to_numpy().T)}
    grams = {tuple(w[k : k + 13]) for w in items.values() for k in range(len(w) - 12)}
    want = {int(d) for d, t in zip(frame.doc_id, frame.text) if any(tuple(w[k : k + 13]) in grams for w in [words.WORD.findall(t.lower())] for k in range(len(w) - 12))}
    assert want == {r[0] for r in one if r[4] >= 13}
    gone = {int(x) for x in frame.doc_id} - {r.doc_id for r in decontaminate.clean(docs, bench).collect()}
    assert gone == {r[0] for r in one} == {int(x) for x in frame.doc_id} - {r.doc_id for r in decontaminate.clean(docs, bench, broadcast_words=0).collect()}


def test_winnowing_takes_window_minima():
    rng = np.random.default_rng(2)
    g, count = rng.integers(0, 9, 60).astype(np.uint64), np.array([20, 3, 37])
    got = set(decontaminate.winnow(g, count, np.array([0, 20, 23, 60]), 6).tolist())
    want, at = set(), 0
    for n in count:
        for a in range(max(1, n - 5)):
            win = g[at + a : at + min(n, a + 6)]
            want.add(at + a + int(len(win) - 1 - win[::-1].argmin()))
        at += n
    assert got == want


# 8: mixing
def test_totals_are_balanced(spark):
    rows = [(i, "w " * (1 + i * 37 % 90), f"s{i % 3}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.decisions(df, weights={"s0": 0.5, "s1": 0.3, "s2": 0.2}, bucket=200).toPandas()
    assert set(got.kept) == {0, 1} and len(got) == 3000
    for _, part in got.groupby("source"):
        assert abs(part.kept.sum() - part.pi.sum()) <= 1
        assert abs((part.kept * part.n_tokens).sum() - (part.pi * part.n_tokens).sum()) <= 2 * part.n_tokens.max()
    share = got[got.kept == 1].groupby("source").n_tokens.sum() / got[got.kept == 1].n_tokens.sum()
    assert np.allclose(share, [0.5, 0.3, 0.2], atol=0.01)
    assert got.kept.tolist() == mixing.decisions(df.repartition(7), weights={"s0": 0.5, "s1": 0.3, "s2": 0.2}, bucket=200).toPandas().set_index("doc_id").kept[got.doc_id].tolist()


def test_flight_keeps_probabilities():
    pi, t = np.array([0.3, 0.5, 0.2, 0.6, 0.4]), np.array([5, 1, 3, 2, 4])
    hits = Counter()
    for k in range(3000):
        u = np.random.default_rng(k).random(5)
        p = mixing.landing(mixing.flight(pi, t, u), u[::-1].copy())
        hits.update(np.flatnonzero(p == 1).tolist())
        assert abs(p.sum() - 2) < 1e-6
    assert np.allclose([hits[i] / 3000 for i in range(5)], pi, atol=0.06)


# 9: toxicity
def misspelled(rng, term):
    s = list(term)
    for _ in range(rng.randrange(4)):
        k, at = rng.randrange(4), rng.randrange(len(s)) if s else 0
        if k == 0 and len(s) > 1:
            del s[at]
        elif k == 1:
            s.insert(at, rng.choice("abcdeimostéx"))
        elif k == 2:
            s[at] = rng.choice("abcdeimost")
        elif at + 1 < len(s):
            s[at], s[at + 1] = s[at + 1], s[at]
    return "".join(s)


def nearest(word, weights):
    return min(((toxicity.edits(t, word), -weights[t], t) for t in weights if t[0] == word[0] and toxicity.edits(t, word) <= toxicity.allowed(t)), default=None)


def test_trie_walk_is_the_edit_distance():
    rng = random.Random(3)
    weights = {"".join(rng.choice("abcdeimosté") for _ in range(rng.randrange(2, 12))): rng.choice([0.5, 1.0]) for _ in range(200)} | {"idiot": 1.0, "moron": 0.9}
    trie = toxicity.Trie(weights)
    tried = sorted({misspelled(rng, t) for t in list(weights) * 4} | {"", "zzz"})
    for w, t, d in zip(tried, *trie.near(tried)):
        want = nearest(w, weights) if w else None
        assert (None if t < 0 else (int(d), -weights[trie.terms[t]], trie.terms[t])) == want, w


def test_many_terms_are_ready_at_once():
    import time

    rng = random.Random(4)
    began = time.perf_counter()
    toxicity.Trie({"".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randrange(5, 11))): 1.0 for _ in range(10_000)})
    assert time.perf_counter() - began < 5


def test_toxic_rows_are_those_of_brute_force(spark):
    """Plain hits: no quotation, no report, no address around them, so that a score is the term's weight by its edits."""
    rng = random.Random(9)
    weights = {"zorgling": 1.0, "blarfen": 0.9, "quux": 1.0, "mirkol": 0.5}
    rows = []
    for i in range(400):
        text = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            text.insert(rng.randrange(len(text) + 1), misspelled(rng, rng.choice(list(weights))))
        rows.append((i // 2, " ".join(text)))
    rows += [(None, "a zorgling"), (7, None), (8, "")]
    want = []
    for i, text in rows:
        hits = []
        for m in re.finditer(r"\w+", text or ""):
            if near := nearest(m[0], weights):
                hits.append((m.start(), m.end(), near[2], near[0], round(weights[near[2]] * (1.0, 0.7, 0.35)[near[0]], 4)))
        total = 1 - np.prod([1 - min(0.99, h[4]) for h in hits])
        if hits and (max(h[4] for h in hits) >= 0.4 or total >= 0.8):
            want.append((i, round(float(total), 4), hits))
    got = [(r.doc_id, r.score, [tuple(h) for h in r.hits]) for r in toxicity.toxic(spark.createDataFrame(rows, "doc_id bigint, text string"), lexicon=weights).collect()]
    assert len(want) > 100 and sorted(got, key=str) == sorted(want, key=str)


def test_quotation_is_milder_than_abuse(spark):
    rows = [(1, "you are an idiot and a m0ron, moronn"), (2, 'the witness said the word "idiot" was used'), (3, "a calm day")]
    got = {r.doc_id: r.score for r in toxicity.toxic(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert 1 in got and 3 not in got and got.get(2, 0) < got[1]


def test_learned_terms(spark):
    rng = random.Random(5)
    plain = [f"w{rng.randrange(400)}" for _ in range(40_000)]
    rows = []
    for i in range(400):
        text = plain[i * 100 : i * 100 + 100]
        if i % 4 == 0:
            text[10], text[50], text[70] = rng.choice(["zorgle", "blarfen"]), "zorgle", "blarfen"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 200)], "doc_id bigint, toxic int")
    assert {"zorgle", "blarfen"} <= toxicity.learn(docs, labels).terms
    got = {r.doc_id for r in toxicity.toxic(docs, labels).collect()}
    want = set(range(0, 400, 4))
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 2


# 10: embeddings
def test_cells_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(600, 32))
    x = np.concatenate([base, base[:200] + rng.normal(size=(200, 32)) * 0.1, base[:50]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(u @ u.T >= 0.95, 1))
    node, comp = common.union_find(a, b)
    want = {(int(c), int(n)) for n, c in zip(node, comp) if n != c}
    got = {(r.rep_id, r.vec_id) for r in embedding_dedup.near_duplicates(df, cell=40, block=16).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)
