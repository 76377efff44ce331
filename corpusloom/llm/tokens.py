"""Token ids in binary shards, compressed by Re-Pair.

Texts are encoded with a public byte-level vocabulary. A shard is about ``shard_tokens`` tokens of one input
partition. In it, pairs of ids that occur often enough to pay for their rule are replaced by nonterminals, all
frequent pairs of a round at once, until no pair is frequent. Pairs never cross documents, so each document
is a string of codes of its own, and a row of its own; each shard's rules, with the length of each one's
expansion, are one more row. Any range of a document's tokens is decoded without expanding what precedes it.

Rows: ``shard``; for a document ``doc_id, n_tokens, width, codes`` (``width`` bits a code, the lowest first, filled up to whole bytes);
for a shard's rules ``width``, ``rules`` (pairs of codes, ``width`` bits each; rule i is id ``base + i``) and ``lengths`` (a byte that
names their bits, then the lengths). :func:`unpack`, :func:`unpack_rules` and :func:`unpack_lengths` read them.

Defined results: a null text gives a row with null n_tokens and codes, an empty one 0 tokens and no codes; a
null doc_id stays null. Repeated rows are encoded each. Ids are the vocabulary's own for every text, however long its runs of
letters or blanks. A document above the size of a shard makes one by itself. A shard without frequent pairs has empty rules.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import read_table
from corpusloom.llm.words import as_texts, mix, text_buffer

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHARD_TOKENS = 1 << 20
#: Occurrences of a pair that pay for a rule, which takes two codes and a shorter number, and those by which the rounds begin: the most frequent pairs are replaced first.
PAYS, FIRST_COUNT = 3, 1024
#: Pairs of so few occurrences are counted in so many times the buckets.
FEW, MORE = 8, 8
SCHEMA = "shard string, doc_id bigint, n_tokens bigint, width int, codes binary, rules binary, lengths binary"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


@lru_cache(2)
def encoding(vocabulary: str):
    with open(vocabulary, "rb") as f:
        return encoding_of(f.read())


@lru_cache(2)
def encoding_of(content: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_L, _N, _S, _O = 0, 1, 2, 3
_ASCII = np.full(256, _O, np.uint8)
_ASCII[[*range(65, 91), *range(97, 123)]] = _L
_ASCII[48:58] = _N
_ASCII[[*range(9, 14), 32]] = _S


@lru_cache(1)
def _classes() -> np.ndarray:
    """Letter, number, space or other of every code point, as the pattern has them."""
    import unicodedata

    out = np.full(0x110000, _O, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            out[c] = _L if kind == "L" else _N
    out[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _S
    return out


def _kinds(buf: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    kind = _ASCII[buf]
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead):
        b0 = buf[lead].astype(np.int64)
        size = 2 + (b0 >= 0xE0) + (b0 >= 0xF0)
        code = b0 & np.where(size == 2, 0x1F, np.where(size == 3, 0x0F, 0x07))
        for j in range(1, 4):
            more = size > j
            code[more] = code[more] << 6 | buf[lead[more] + j] & 0x3F
        what = _classes()[code]
        kind[lead] = what
        for j in range(1, 4):
            more = size > j
            kind[lead[more] + j] = what[more]
    return kind


def piece_starts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where the pieces of :data:`PATTERN` start in the bytes of several texts."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = _kinds(buf)
    edge = off[(off > 0) & (off < n)]
    turn = np.empty(n, bool)
    turn[0] = True
    np.not_equal(kind[1:], kind[:-1], out=turn[1:])
    begins = np.zeros(n, bool)
    begins[edge] = True
    begins[0] = True
    turn[edge] = True
    run = np.flatnonzero(turn)
    end = np.r_[run[1:], n]
    space = kind[run] == _S
    start = np.zeros(n, bool)
    # a blank before a run belongs to it; other white space is a piece, but for its last character
    words = run[~space]
    joined = (words > 0) & ~begins[words]
    joined[joined] = buf[words[joined] - 1] == 32
    start[words - joined] = True
    blank, stop = run[space], end[space]
    start[blank] = True
    inner = (stop < n) & ~begins[np.minimum(stop, n - 1)]
    last = stop[inner] - 1
    while True:  # back to the first byte of the last character
        tail = (buf[last] & 0xC0) == 0x80
        if not tail.any():
            break
        last = last - tail
    start[last] = True
    quote = run[(buf[run] == 39) & (end - run == 1)]
    for q in quote[start[quote]].tolist():  # a lone apostrophe that no blank precedes may begin a contraction
        near = bytes(buf[q + 1 : q + 3])
        size = 2 if near[:1] in (b"s", b"t", b"m", b"d") else 3 if near in (b"re", b"ve", b"ll") else 0
        if not size or begins[q + 1 : q + size].any() or q + size > n:
            continue
        start[q + 1] = False
        if q + size < n and kind[q + size] == _L and not begins[q + size]:
            start[q + size] = True
    return np.flatnonzero(start)


#: The encoder keeps the last piece of each of so many hash values (a power of 2) at hand.
_CACHE = 18
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def _keys(data: bytes, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit key of each piece of up to 16 bytes, and which pieces are longer."""
    word = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    key = mix((word[start] & _MASK[np.minimum(size, 8)]) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    more = np.flatnonzero(size > 8)
    key[more] = mix(key[more] ^ (word[start[more] + 8] & _MASK[np.minimum(size[more] - 8, 8)]))
    return key, size > 16


class Encoder:
    """Encodes batches of texts; each distinct piece of text is encoded once and remembered."""

    def __init__(self, vocabulary: str | bytes, remember: int = 400_000):
        self.enc = encoding_of(vocabulary) if isinstance(vocabulary, bytes) else encoding(vocabulary)
        self.remember = remember
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.count = self.bytes = 0
        self.begin, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat, self.used = np.zeros(1 << 18, np.int32), 0
        self.known, self.where = np.zeros(1 << _CACHE, np.uint64), np.zeros(1 << _CACHE, np.int32)

    def _slots(self, pieces: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.slot.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(out < 0)
        if len(new):
            fresh = [pieces[i] for i in new.tolist()]
            lists = list(map(self.enc._core_bpe.encode_single_piece, fresh))
            size = np.fromiter(map(len, lists), np.int64, len(lists))
            k, m, total = self.count, len(new), int(size.sum())
            while k + m > len(self.begin):
                self.begin, self.size = np.resize(self.begin, 2 * len(self.begin)), np.resize(self.size, 2 * len(self.size))
            while self.used + total > len(self.flat):
                self.flat = np.resize(self.flat, 2 * len(self.flat))
            self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(lists), np.int32, total)
            self.begin[k : k + m] = self.used + np.cumsum(size) - size
            self.size[k : k + m] = size
            self.used += total
            self.count += m
            self.bytes += sum(map(len, fresh))
            out[new] = np.arange(k, k + m)
            self.slot.update(zip(fresh, range(k, k + m)))
        return out

    def _segment(self, buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        start = piece_starts(buf, off)
        n = len(start)
        if n == 0:
            return [np.zeros(0, np.int32)] * (len(off) - 1)
        data = buf.tobytes() + bytes(16)
        end = np.empty(n, np.int64)
        end[:-1], end[-1] = start[1:], len(buf)
        key, rare = _keys(data, start, end - start)
        place = (key >> np.uint64(64 - _CACHE)).astype(np.int64)
        slot = np.where(self.known[place] == key, self.where[place], -1)
        slot[rare] = -1
        miss = np.flatnonzero(slot < 0)
        if len(miss):
            key[miss[rare[miss]]] = 0  # longer than a key tells: looked up one by one
            _, first, which = np.unique(key[miss], return_index=True, return_inverse=True)
            if self.count + len(miss) > self.remember:
                self._forget()
                return self._segment(buf, off) if len(miss) < self.remember else self._all(data, start, end, off)
            at = miss[first]
            found = self._slots([data[x:y] for x, y in zip(start[at].tolist(), end[at].tolist())])
            slot[miss] = found[which]
            lone = np.flatnonzero(rare)
            if len(lone):
                slot[lone] = self._slots([data[x:y] for x, y in zip(start[lone].tolist(), end[lone].tolist())])
            at = at[~rare[at]]
            self.known[place[at]], self.where[place[at]] = key[at], slot[at]
        return self._cut(slot, start, off)

    def _all(self, data: bytes, start: np.ndarray, end: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        out = self._cut(self._slots([data[x:y] for x, y in zip(start.tolist(), end.tolist())]), start, off)
        self._forget()
        return out

    def _cut(self, slot: np.ndarray, start: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        size = self.size[slot]
        stop = np.cumsum(size)
        ids = self.flat[np.repeat(self.begin[slot] - (stop - size), size) + np.arange(int(stop[-1]))]
        cut = np.r_[0, stop][np.searchsorted(start, off)]
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]

    def __call__(self, texts: pa.Array, segment: int = 1 << 20) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        buf, off = text_buffer(texts)
        i, n = 0, len(texts)
        while i < n:
            if self.bytes > 1 << 26:  # very long pieces
                self._forget()
            j = i + 1
            while j < n and off[j + 1] - off[i] <= segment:
                j += 1
            yield from self._segment(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            i = j


def repair(seq: np.ndarray, base: int, min_count: int, buckets: int = 1 << 18, most: int = 1 << 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sequence in codes, the rules (n, 2) and the expansion lengths. Negative ids part documents.

    Each round takes the exact counts of pairs and replaces every frequent one; of overlapping occurrences the more frequent pair's is
    replaced, and of one pair's every other one. After a round only pairs with a new symbol can have become frequent, so only
    they are counted, along the links between the symbols that are left; when none is frequent any more, what is frequent goes down by halves from
    ``FIRST_COUNT`` to ``min_count`` and all pairs are counted once more, in hashed buckets first. There are ``most`` rules at most.
    """
    now = max(min_count, FIRST_COUNT)
    rules: list[np.ndarray] = []
    n_rules, new = 0, None  # places of the symbols that the last round made
    seq = seq.astype(np.int32)
    live = None
    while n_rules < most:
        if new is None:
            if live is not None:
                seq = seq[live]
            n = len(seq)
            if n < 2:
                break
            live = np.ones(n, bool)
            after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
            a, b = seq[:-1], seq[1:]
            slot, other = a.view(np.uint32) * np.uint32(0x9E3779B1), b.view(np.uint32) * np.uint32(0x85EBCA77)
            slot ^= other
            np.right_shift(slot, np.uint32(15), out=other)
            slot ^= other
            several = buckets if now > FEW else MORE * buckets  # rare pairs would share most buckets with others, and be sorted for nothing
            slot &= np.uint32(several - 1)
            slot = slot.astype(np.int64)
            at = np.flatnonzero((np.bincount(slot, minlength=several) >= now)[slot])
            a, b = a[at], b[at]
        else:
            left = before[new]
            left = left[left >= 0]
            at = np.empty(len(left) + len(new), np.int64)
            at[: len(left)], at[len(left) :] = left, new
            at.sort(kind="stable")
            at = at[np.r_[True, at[1:] != at[:-1]] & (after[at] < n)]
            a, b = seq[at], seq[after[at]]
        within = np.minimum(a, b) >= 0
        at, a, b = at[within], a[within], b[within]
        pair, which, count = np.unique(a.astype(np.int64) << 32 | b, return_inverse=True, return_counts=True)
        use = count >= now
        if use.any():
            keep = use[which]
            at, which = at[keep], which[keep]
            near = after[at[:-1]] == at[1:]
            start = np.r_[True, ~near]
            place = np.arange(len(at))
            even = (place - np.maximum.accumulate(np.where(start, place, 0))) % 2 == 0
            weight = count[which] << 24 | which & 0xFFFFFF
            ahead, behind = np.full(len(at), -1), np.full(len(at), -1)
            ahead[:-1][near], behind[1:][near] = weight[1:][near], weight[:-1][near]
            take = (weight >= ahead) & (weight >= behind) & (even | (weight != ahead) & (weight != behind))
            take[1:] &= ~(take[:-1] & near)  # a pair's run may end beside a taken one
            at, which = at[take], which[take]
            done = np.bincount(which, minlength=len(pair))
            use &= done >= min(now, max(2, min_count))
        if not use.any():
            if now == min_count and new is None:
                break
            if new is None or now > min_count:
                now = max(min_count, now // 2)
            new = None
            continue
        order = np.flatnonzero(use)
        order = order[np.lexsort((pair[order], -done[order]))][: most - n_rules]
        use[:] = False
        use[order] = True
        name = np.zeros(len(pair), np.int32)
        name[order] = base + n_rules + np.arange(len(order), dtype=np.int32)
        keep = use[which]
        new, which = at[keep], which[keep]
        right = after[new]
        live[right] = False
        beyond = after[right]
        seq[new], after[new] = name[which], beyond
        inside = beyond < n
        before[beyond[inside]] = new[inside]
        rules.append(np.stack([pair[order] >> 32, pair[order] & 0xFFFFFFFF], axis=1).astype(np.uint32))
        n_rules += len(order)
    all_rules = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    return seq if live is None else seq[live], all_rules, expansion_lengths(rules, base)


def expansion_lengths(rounds: list[np.ndarray], base: int) -> np.ndarray:
    out = np.zeros(0, np.uint32)
    for r in rounds:  # a round's rules refer to earlier rounds only
        size = np.where(r >= base, out[np.clip(r.astype(np.int64) - base, 0, len(out) - 1)] if len(out) else 1, 1)
        out = np.concatenate([out, size.sum(axis=1).astype(np.uint32)])
    return out


def decode_ids(codes: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Tokens start to stop of a document; codes outside the range aren't expanded."""
    codes = codes.astype(np.int64)
    size = np.ones(len(codes), np.int64)
    big = codes >= base
    size[big] = lengths[codes[big] - base]
    end = np.cumsum(size)
    total = int(end[-1]) if len(end) else 0
    stop = total if stop is None else min(stop, total)
    start = max(0, start)
    if start >= stop:
        return np.zeros(0, np.int64)
    i, j = int(np.searchsorted(end, start, "right")), int(np.searchsorted(end, stop))
    skip = start - (int(end[i]) - int(size[i]))
    out = codes[i : j + 1]
    while (out >= base).any():
        big = out >= base
        at = np.cumsum(1 + big) - 1 - big
        new = np.empty(len(out) + int(big.sum()), np.int64)
        new[at[~big]] = out[~big]
        pair = rules[out[big] - base].astype(np.int64)
        new[at[big]], new[at[big] + 1] = pair[:, 0], pair[:, 1]
        out = new
    return out[skip : skip + stop - start]


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    """(n, width): the bits of each value, the lowest first."""
    return np.unpackbits(values.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]


def pack(values: np.ndarray, width: int) -> bytes:
    return np.packbits(_bits(values, width).ravel(), bitorder="little").tobytes()


def unpack(codes: bytes, width: int) -> np.ndarray:
    """The codes of a document."""
    bits = np.unpackbits(np.frombuffer(codes, np.uint8), bitorder="little")
    n = len(bits) // width  # what fills up the last byte is less than a code
    out = np.zeros((n, 32), np.uint8)
    out[:, :width] = bits[: n * width].reshape(n, width)
    return np.packbits(out, axis=1, bitorder="little").view("<u4").ravel()


def unpack_rules(rules: bytes, width: int) -> np.ndarray:
    return unpack(rules, width).reshape(-1, 2)


def unpack_lengths(lengths: bytes) -> np.ndarray:
    return unpack(lengths[1:], lengths[0])


def _length_bits(lengths: np.ndarray) -> int:
    return max(8, int(lengths.max(initial=1)).bit_length())


def expanded(seq: np.ndarray, rules: np.ndarray, base: int, n: int) -> np.ndarray:
    """``seq`` without codes of the rules from ``n`` on: each of these is expanded once, then put in wherever it stands."""
    over = np.flatnonzero(seq >= base + n)
    if not len(over):
        return seq
    there = np.zeros(len(rules) - n, np.int64)
    there[seq[over] - base - n] = 1
    flat = np.flatnonzero(there) + base + n
    owner = np.arange(len(flat))
    while (big := flat >= base + n).any():
        at = np.cumsum(1 + big) - 1 - big
        new = np.empty(len(flat) + int(big.sum()), np.int64)
        new[at[~big]] = flat[~big]
        new[at[big]], new[at[big] + 1] = rules[flat[big] - base].T
        flat, owner = new, np.repeat(owner, 1 + big)
    size = np.bincount(owner)
    which = (np.cumsum(there) - 1)[seq[over] - base - n]
    sizes = size[which]
    grown = np.ones(len(seq), np.int64)
    grown[over] = sizes
    begin = np.cumsum(sizes) - sizes
    within = np.arange(int(sizes.sum()))
    at = np.repeat(np.cumsum(grown)[over] - sizes - begin, sizes) + within
    out = np.repeat(seq, grown)
    out[at] = flat[np.repeat((np.cumsum(size) - size)[which] - begin, sizes) + within]
    return out


def repaired(seq: np.ndarray, base: int, min_count: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The result of :func:`repair` with the bits of a code.

    Of the widths that hold the first so many rules the one is taken with which codes, rules and lengths are the smallest; codes
    of the rules beyond are expanded again.
    """
    seq, rules, lengths = repair(seq, base, PAYS if min_count is None else min_count)
    widths = range(max(base - 1, 1).bit_length(), max(base + len(rules) - 1, 1).bit_length() + 1)
    used = np.bincount(seq[seq >= base] - base, minlength=len(rules))
    plain = int((seq >= 0).sum() - used.sum())
    best = None
    reach = np.maximum.accumulate(rules.max(axis=1)) if len(rules) else rules[:, 0]
    for width in widths:
        n = min(len(rules), (1 << width) - base)
        parts = np.ones(len(rules), np.int64)  # codes of each rule where only n are kept
        at = n
        while at < len(rules):  # rules that refer to none beyond ``at`` are known at once
            end = int(np.searchsorted(reach, base + at))
            part = rules[at:end].astype(np.int64) - base
            parts[at:end] = np.where(part >= n, parts[np.maximum(part, 0)], 1).sum(axis=1)
            at = end
        bits = width * (plain + int(used @ parts) + 2 * n) + n * _length_bits(lengths[:n])
        if best is None or bits < best[0]:
            best = bits, width, n
    _, width, n = best
    return expanded(seq, rules, base, n), rules[:n], lengths[:n], width


def _encoded(vocabulary, shard_tokens: int, min_count: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        base = encoder.enc.n_vocab
        part, k = TaskContext.get().partitionId(), 0
        ids: list = []
        docs: list[np.ndarray | None] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal k, ids, docs, size
            sep = np.array([-1], np.int32)
            whole = [x for d in docs if d is not None for x in (d, sep)]
            seq, rules, lengths, width = repaired(np.concatenate(whole) if whole else sep, base, min_count)
            cut = np.flatnonzero(seq < 0)
            bits = np.maximum(seq, 0).astype("<u2") if width == 16 else _bits(np.maximum(seq, 0), width)
            codes, at, j = [], 0, 0
            for d in docs:
                if d is None:
                    codes.append(None)
                    continue
                own = bits[at : cut[j]]
                codes.append(own.tobytes() if width == 16 else np.packbits(own.ravel(), bitorder="little").tobytes())
                at, j = int(cut[j]) + 1, j + 1
            shard, n = f"{part:06d}-{k:05d}", len(docs)
            none = [None] * n
            rows = [
                [shard] * (n + 1), [*ids, None], [*(None if d is None else len(d) for d in docs), None], [*(None if d is None else width for d in docs), width],
                [*codes, None], [*none, pack(rules.ravel(), width)], [*none, bytes([most := _length_bits(lengths)]) + pack(lengths, most)],
            ]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            k, ids, docs, size = k + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], _NAMES)

        for b in batches:
            null = b["text"].is_null().to_pylist()
            for doc, none, seq in zip(b["doc_id"].to_pylist(), null, encoder(as_texts(b["text"]))):
                seq = None if none else seq
                more = 0 if seq is None else len(seq)
                if size and size + more > shard_tokens:
                    yield flush()
                ids.append(doc)
                docs.append(seq)
                size += more
        if docs:
            yield flush()

    return run


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY, shard_tokens: int = SHARD_TOKENS, min_count: int | None = None) -> DataFrame:
    """``docs`` as rows of :data:`SCHEMA`. One pass over the input partitions, no shuffle.

    :param vocabulary: file of the driver, or of a file system that Spark reads; its content is sent to the tasks
    """
    spark = docs.sparkSession
    if os.path.exists(vocabulary):
        with open(vocabulary, "rb") as f:
            content = f.read()
    else:
        content = bytes(spark.read.format("binaryFile").load(vocabulary).select("content").first()[0])
    vocabulary = spark.sparkContext.broadcast(content)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encoded(vocabulary, shard_tokens, min_count), SCHEMA)


def op4_repair_tokens(spark, sf_dir):
    return encoded(read_table(spark, sf_dir, "documents"))


QUERIES = {"op4_repair_tokens": op4_repair_tokens}
ORACLES: dict[str, str] = {}
