"""Pairs are replaced where that pays, in any shard, and by a plain Re-Pair's measure."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import tokens


@pytest.mark.parametrize("base", [50_000, 70_000])
def test_break_even(base):
    for n in (tokens.PAYS - 1, tokens.PAYS):
        rng = np.random.default_rng(n)
        seq = np.concatenate([np.r_[5, 6, rng.permutation(np.arange(100, 40_000))[:3], -1] for _ in range(n)]).astype(np.int32)
        out, rules, lengths, w = tokens.repaired(seq, base)
        assert w == (base - 1).bit_length() and rules.tolist() == ([[5, 6]] if n == tokens.PAYS else [])
        assert tokens.decode_ids(out[out >= 0].astype(np.uint32), rules, lengths, base).tolist() == seq[seq >= 0].tolist()


def bits(n_codes, rules, lengths, width):
    return width * (n_codes + 2 * len(rules)) + len(rules) * max(8, int(max(lengths, default=1)).bit_length())


def test_the_narrower_width_is_taken_where_it_pays():
    for base, many in ((65_530, 60), (65_500, 4000)):
        seq = np.random.default_rng(1).integers(0, many, 60_000).astype(np.int32)
        out, rules, lengths, w = tokens.repaired(seq, base)
        full, all_rules, all_lengths = tokens.repair(seq, base, tokens.PAYS)
        assert bits(len(out), rules, lengths, w) <= bits(len(full), all_rules, all_lengths, (base + len(all_rules) - 1).bit_length())
        assert base + len(rules) <= 1 << w and out.max() < base + len(rules)
        assert tokens.decode_ids(out.astype(np.uint32), rules, lengths, base).tolist() == seq.tolist()


def test_codes_are_packed():
    for width in (8, 16, 17, 31):
        v = np.random.default_rng(width).integers(0, 1 << width, 41).astype(np.uint32)
        data = tokens.pack(v, width)
        assert len(data) == -(-41 * width // 8) and tokens.unpack(data, width).tolist() == v.tolist()


def plain(docs, base):
    """One pair at a time, the most frequent."""
    docs, rules = [list(d) for d in docs], []
    while True:
        count = Counter()
        for d in docs:
            last = None
            for k, p in enumerate(zip(d, d[1:])):
                if p == last:  # overlapping occurrences count once
                    last = None
                    continue
                count[p] += 1
                last = p if p[0] == p[1] else None
        best = min(count, key=lambda p: (-count[p], p), default=None)
        if best is None or count[best] < tokens.PAYS:
            return docs, rules
        new, rules = base + len(rules), [*rules, best]
        for k, d in enumerate(docs):
            out, i = [], 0
            while i < len(d):
                if tuple(d[i : i + 2]) == best:
                    out.append(new)
                    i += 2
                else:
                    out.append(d[i])
                    i += 1
            docs[k] = out


def test_rounds_are_worth_a_plain_re_pair():
    rng = random.Random(2)
    for vocabulary, n in ((20, 3000), (200, 6000), (3, 500)):
        phrases = [[rng.randrange(vocabulary) for _ in range(rng.randrange(2, 9))] for _ in range(40)]
        docs = []
        while sum(map(len, docs)) < n:
            docs.append([x for _ in range(rng.randrange(1, 30)) for x in (rng.choice(phrases) if rng.random() < 0.8 else [rng.randrange(vocabulary)])])
        seq = np.array([x for d in docs for x in (*d, -1)], np.int32)
        out, rules, lengths, width = tokens.repaired(seq, 1000)
        cut = np.flatnonzero(out < 0)
        for d, a, b in zip(docs, [0, *(cut[:-1] + 1)], cut):
            assert tokens.decode_ids(out[a:b], rules, lengths, 1000).tolist() == d
        want, pairs = plain(docs, 1000)
        mine = width * ((out >= 0).sum() + 2 * len(rules))
        assert mine <= 1.06 * (1000 + len(pairs) - 1).bit_length() * (sum(map(len, want)) + 2 * len(pairs)), (mine, len(pairs))


def test_long_runs_have_the_vocabulary_s_ids(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefghij") for _ in range(10_000)), " " * 10_000 + "x", "é" * 4000, "a " + "\n" * 5000, "1" * 7000, "ab" * 3_000_000]
    enc = tokens.encoding(tokens.VOCABULARY)
    got = list(tokens.Encoder(tokens.VOCABULARY)(pa.array(texts)))
    for t, g in zip(texts, got):
        want = enc._core_bpe.encode_single_piece(t.encode()) if len(t) > 1_000_000 else enc.encode(t, disallowed_special=())
        assert g.tolist() == list(want)
    rows = {r.doc_id: r for r in tokens.encoded(spark.createDataFrame(list(enumerate(texts[:5])), "doc_id bigint, text string").coalesce(1)).collect()}
    for i in range(5):
        ids = tokens.decode_ids(tokens.unpack(rows[i].codes, rows[i].width), tokens.unpack_rules(rows[None].rules, rows[None].width), tokens.unpack_lengths(rows[None].lengths), enc.n_vocab)
        assert ids.tolist() == got[i].tolist() and rows[i].n_tokens == len(got[i])
