"""Byte-pair encoding over characters: learning merges, encoding, decoding, evaluation.

Merges are learned from distinct words with their counts. Up to ``LOCAL_WORDS`` of them (counted) go to one task,
which keeps the symbols in arrays as it merges. More are dealt out to all tasks that can run at once, ``LOCAL_WORDS`` to each at most: these tell each other how pair counts change, and what is merged next.
An even larger table stays where it is: each round aggregates its pairs and merges, in one projection,
all of the most frequent ones that don't touch each other, as many as would come up one after the other anyway. All give the same merges.
"""

from __future__ import annotations

import contextlib
import heapq
import hmac
import secrets
import socket
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from corpusloom.functions import text as tx
from corpusloom.functions.pretokens import Pretokenizer, kinds, marked, whole
from corpusloom.operators import counts
from corpusloom.operators.components import dropped
from corpusloom.sources.shared import written

LOCAL_WORDS = 2_000_000
#: Pairs that a round looks at, at most.
ROUND = 1000
SILENT = ("<pad>", "<bos>", "<eos>")
#: Words of more characters than this are encoded by a queue.
LONG_WORD = 200
#: Words of at most so many characters are encoded in blocks of so many words; a place fits PLACE bits.
SHORT_WORD, BLOCK, PLACE = 32, 8192, 5


def merged(symbols: list[str], left: str, right: str) -> list[str]:
    out, i = [], 0
    while i < len(symbols):
        if i + 1 < len(symbols) and symbols[i] == left and symbols[i + 1] == right:
            out.append(left + right)
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


def code_points(words: pa.Array) -> np.ndarray:
    """The characters of all words, one word's after the other's."""
    off = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset) if len(words) else [0, 0]
    return np.frombuffer((words.buffers()[2] or pa.py_buffer(b"")).slice(off[0], off[-1] - off[0]).to_pybytes().decode().encode("utf-32-le"), np.uint32)


class Places:
    """The symbols of words with their counts, in arrays: words lie one after the other, with a place between two that holds no symbol.

    Where a pair stands is kept from the moment that it comes up: the words' own pairs in ``order``, others by the symbol whose making brought them about,
    in the order of what stood right or left of it. So a merge looks at the places of its pair only, not at all of its symbols'.
    """

    def __init__(self, words: pa.Array, freq: np.ndarray, alphabet: np.ndarray, letters: np.ndarray | None = None):
        size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        letters = code_points(words) if letters is None else letters
        total, self.letters = len(letters) + len(size) + 1, len(alphabet)
        place = np.arange(len(letters)) + np.repeat(np.arange(1, len(size) + 1), size)
        kind = np.int32 if total < 1 << 31 else np.int64
        number = np.zeros(int(alphabet.max(initial=0)) + 1, np.int32)
        number[alphabet] = np.arange(len(alphabet))
        self.symbol = np.full(total, -1, np.int32)
        self.symbol[place] = number[letters]
        self.freq = np.zeros(total, np.int32 if freq.max(initial=0) < 1 << 31 else np.int64)
        self.freq[place] = np.repeat(freq, size)
        del letters, place
        self.after, self.before = np.arange(1, total + 1, dtype=kind), np.arange(-1, total - 1, dtype=kind)
        self.mark = np.zeros(total, bool)  # for a moment: places that a merge has seen to
        at = np.flatnonzero((self.symbol[:-1] >= 0) & (self.symbol[1:] >= 0)).astype(kind)
        for x in (1, 0):
            at = at[sorting(self.symbol[at + x])]
        self.order, key = at, self.symbol[at].astype(np.int64) << 32 | self.symbol[at + 1]
        self.cut = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)] if len(key) else np.zeros(1, np.int64)
        self.key = key[self.cut[:-1]]
        self.left_of: dict[int, list] = {}
        self.right_of: dict[int, list] = {}

    def keyed(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of ``at`` where a pair begins, and its key."""
        at = at[self.symbol[at] >= 0]
        right = self.symbol[self.after[at]]
        at, right = at[right >= 0], right[right >= 0]
        return at, self.symbol[at].astype(np.int64) << 32 | right

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys and counts of the words' own pairs."""
        if not len(self.key):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        total = np.add.reduceat(self.freq[self.order], self.cut[:-1], dtype=np.int64)
        return self.key[total != 0], total[total != 0]

    def of(self, a: int, b: int) -> np.ndarray:
        """Where ``a`` stands before ``b``."""
        kept = [(self.key, self.cut, self.order, a << 32 | b)] if a < self.letters and b < self.letters else []
        kept += [(*x, b) for x in self.right_of.get(a, ())] + [(*x, a) for x in self.left_of.get(b, ())]
        found = [np.zeros(0, self.after.dtype)]
        for key, cut, places, k in kept:
            i = int(np.searchsorted(key, k))
            if i < len(key) and key[i] == k:
                found.append(places[cut[i] : cut[i + 1]])
        at = np.concatenate(found).astype(np.intp)
        at = at[self.symbol.take(at) == a]  # some have been merged since
        return at[self.symbol.take(self.after.take(at)) == b]

    def _keep(self, kept: dict[int, list], result: int, beside: np.ndarray, places: np.ndarray, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keeps places by the symbol beside ``result``; these symbols with their sums."""
        order = sorting(beside)
        beside = beside[order]
        cut = np.r_[0, np.flatnonzero(beside[1:] != beside[:-1]) + 1, len(beside)]
        symbols, total = beside[cut[:-1]].astype(np.int64), np.add.reduceat(freq[order], cut[:-1], dtype=np.int64)
        if symbols[0] < 0:  # a word's end
            symbols, total, cut = symbols[1:], total[1:], cut[1:]
        if len(symbols):
            kept.setdefault(result, []).append((symbols, cut, places[order].astype(self.after.dtype)))
        return symbols, total

    def merge(self, a: int, b: int, result: int) -> tuple[np.ndarray, np.ndarray]:
        """Makes ``result`` of ``a`` and ``b`` wherever they meet; keys whose counts change, and by what."""
        symbol, after, before = self.symbol, self.after, self.before
        at = self.of(a, b)
        if a == b:  # of a run every other one, from the left
            at = np.unique(at)
            start = np.r_[True, after[at[:-1]] != at[1:]] if len(at) else np.zeros(0, bool)
            k = np.arange(len(at))
            at = at[(k - np.maximum.accumulate(np.where(start, k, 0))) % 2 == 0]
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        gone = after.take(at).astype(np.intp)
        ahead, beyond, freq = before.take(at).astype(np.intp), after.take(gone).astype(np.intp), self.freq.take(at)
        left, right = symbol.take(ahead), symbol.take(beyond)
        joined = bool((left == b).any())  # the pair may follow itself; what lies between two is the first one's
        if joined:
            self.mark[gone] = True
            own = (left >= 0) & ~self.mark.take(ahead)
            self.mark[gone] = False
            old = (by_symbol(left[own], freq[own]), by_symbol(right[right >= 0], freq[right >= 0]))
        symbol[at], symbol[gone] = result, -2
        after[at], before[beyond] = beyond, at
        if joined:
            ahead = before.take(at).astype(np.intp)
            left, right = symbol.take(ahead), symbol.take(beyond)
        new = self._keep(self.left_of, result, left, ahead, freq), self._keep(self.right_of, result, right, at, freq)
        (left, left_freq), (then, then_freq) = old[0] if joined else new[0], new[1]
        right, right_freq = old[1] if joined else new[1]
        keys = [left << 32 | a, np.array([a << 32 | b]), b << 32 | right, left << 32 | result, result << 32 | then]
        return summed(np.concatenate(keys), np.concatenate([-left_freq, [-int(freq.sum(dtype=np.int64))], -right_freq, left_freq, then_freq]))


def sorting(symbols: np.ndarray) -> np.ndarray:
    """The order of symbols, ties as they are; numbers of 16 bits are sorted by their digits."""
    return np.argsort(symbols.astype(np.int16) if symbols.max(initial=0) < 1 << 15 else symbols, kind="stable")


def by_symbol(symbols: np.ndarray, numbers: np.ndarray, few: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Of many symbols each one with the sum of its numbers; few are left as they are."""
    if len(symbols) < few or numbers.sum(dtype=np.float64) >= 1 << 52:
        return symbols.astype(np.int64), numbers.astype(np.int64)
    total = np.bincount(symbols, numbers)
    there = np.flatnonzero(total)
    return there, total[there].astype(np.int64)


def summed(keys: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, with the sum of its numbers; sums of nothing go."""
    keys, which = np.unique(keys, return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, which, numbers.astype(np.int64))
    return keys[total != 0], total[total != 0]


class Choice:
    """Counts of all pairs, and which are merged next.

    A round has all pairs that would be merged one after the other whatever these merges change, as in :func:`successive`. Only pairs of ``least``
    occurrences or more are queued; that bound falls when none is left.
    """

    def __init__(self, names: list[str], merges: int, at_least: int, known: Iterable[str] | None):
        self.names, self.number = names, {t: i for i, t in enumerate(names)}
        self.left, self.at_least, self.known = merges, at_least, known is not None
        self.made, self.count, self.heap, self.least = set(known or ()), {}, [], None

    def queued(self, k: int) -> tuple:
        return -self.count[k], self.names[k >> 32], self.names[k & 0xFFFFFFFF], k

    def add(self, keys: np.ndarray, changes: np.ndarray) -> None:
        count = self.count
        for k, d in zip(keys.tolist(), changes.tolist()):
            count[k] = c = count.get(k, 0) + d
            if c <= 0:
                del count[k]
            elif d > 0 and self.least is not None and c >= self.least:
                heapq.heappush(self.heap, self.queued(k))

    def top(self) -> tuple | None:
        """The first pair of the queue, taken from it; what has become less since it was queued is queued anew."""
        while True:
            while self.heap:
                entry = heapq.heappop(self.heap)
                now = self.count.get(entry[3], 0)
                if now == -entry[0]:
                    while self.heap and self.heap[0] == entry:  # queued twice
                        heapq.heappop(self.heap)
                    return entry
                if self.least <= now < -entry[0]:
                    heapq.heappush(self.heap, self.queued(entry[3]))
            if not self.count or self.least is not None and self.least <= self.at_least:
                return None
            most = max(self.count.values())
            self.least = max(self.at_least, min(most, self.least or most) // 8)
            self.heap = [self.queued(k) for k, n in self.count.items() if n >= self.least]
            heapq.heapify(self.heap)

    def round(self) -> list[tuple[int, int, int]]:
        """The next merges: left, right, result."""
        taken, back, used, touched, out = [], [], set(), 0, []
        while self.left > 0 and (entry := self.top()):
            a, b = entry[3] >> 32, entry[3] & 0xFFFFFFFF
            if a in used or b in used:
                back.append(entry)
                touched = -entry[0]
                break
            taken.append(entry)
            used |= {a, b}
            # these may bring up pairs that are more frequent: one of a symbol with itself, and one whose result is there already
            name = entry[1] + entry[2]
            if a == b or name in self.number or any(name == x[1] + x[2] for x in taken[:-1]) or len(taken) == self.left:
                if following := self.top():
                    back.append(following)
                    touched = -following[0]
                break
        for i, entry in enumerate(taken):
            if i and -entry[0] <= touched or self.left <= 0:
                back.append(entry)
                continue
            name = entry[1] + entry[2]
            result = self.number.setdefault(name, len(self.names))
            if result == len(self.names):
                self.names.append(name)
            if not self.known or name not in self.made:
                self.left -= 1
                self.made.add(name)
            out.append((entry[3] >> 32, entry[3] & 0xFFFFFFFF, result))
        for entry in back:
            heapq.heappush(self.heap, entry)
        return out


def learn(words: Iterable[tuple[str, int]], merges: int, at_least: int = 2, known: Iterable[str] | None = None) -> list[tuple[str, str]]:
    """The pairs merged one after the other: each time the most frequent, the first of ties; none below ``at_least``.

    With ``known`` tokens, ``merges`` counts the new tokens: a result that is known, or was made of another pair, isn't new.
    """
    table = [x for x in words if x[0]]
    words = pa.array([w for w, _ in table], pa.string())
    return learned(words, np.array([n for _, n in table], np.int64), merges, at_least, known)


def learned(words: pa.Array, freq: np.ndarray, merges: int, at_least: int, known: Iterable[str] | None, meeting: Alone | Meeting | None = None) -> list[tuple[str, str]]:
    """As :func:`learn`. In a ``meeting``, ``words`` are one of several parts, and each part gets the same merges.

    Part 0 collects how the counts change, and tells the others what is merged next.
    """
    meeting = meeting or Alone()
    letters, there = code_points(words), np.zeros(0x110000, bool)
    there[letters] = True
    all_letters = meeting.collect(np.flatnonzero(there).astype(np.uint32).tobytes())
    names = sorted(set(meeting.tell(b"".join(all_letters or ())).decode("utf-32-le")))
    places = Places(words, freq, np.array([ord(c) for c in names], np.uint32), letters)
    del letters
    choice = Choice(list(names), merges, at_least, known) if meeting.part == 0 else None
    change, out = places.pairs(), []
    while True:
        said, chosen = meeting.collect(packed(*change)), b""
        if choice is not None:
            choice.add(*summed(*map(np.concatenate, zip(*map(unpacked, said)))))
            chosen = np.array(choice.round(), np.int64).tobytes()
        chosen = np.frombuffer(meeting.tell(chosen), np.int64).reshape(-1, 3).tolist()
        if not chosen:
            return out
        changes = []
        for a, b, result in chosen:
            out.append((names[a], names[b]))
            if result == len(names):
                names.append(names[a] + names[b])
            changes.append(places.merge(a, b, result))
        change = changes[0] if len(changes) == 1 else summed(*map(np.concatenate, zip(*changes)))


def packed(keys: np.ndarray, changes: np.ndarray) -> bytes:
    return np.stack([keys, changes]).tobytes()


def unpacked(said: bytes) -> tuple[np.ndarray, np.ndarray]:
    keys, changes = np.frombuffer(said, np.int64).reshape(2, -1)
    return keys, changes


MERGES = "rank int, left string, right string, result string"


def _one_task(merges: int, at_least: int, known: tuple[str, ...] | None):
    def run(t: pa.Table) -> pa.Table:
        return _merges(learned(pa.chunked_array(t["word"]).combine_chunks(), t["freq"].to_numpy(), merges, at_least, known))

    return run


def _merges(found: list[tuple[str, str]]) -> pa.Table:
    left, right = ([p[k] for p in found] for k in (0, 1))
    return pa.table({"rank": pa.array(range(len(found)), pa.int32()), "left": pa.array(left, pa.string()), "right": pa.array(right, pa.string()), "result": pa.array([a + b for a, b in found], pa.string())})


def _barrier_parts(spark: SparkSession) -> int:
    """Tasks that can run at once and wait for each other; 0 where that can't be counted on."""
    sc = spark.sparkContext
    if (sc.getConf().get("spark.dynamicAllocation.enabled") or "false").lower() == "true":
        return 0
    jsc = sc._jsc.sc()
    return jsc.maxNumConcurrentTasks(jsc.resourceProfileManager().defaultResourceProfile())


class Alone:
    """A part that has all words."""

    part = 0

    def collect(self, said: bytes) -> list[bytes] | None:
        return [said]

    def tell(self, said: bytes) -> bytes:
        return said


class Meeting:
    """The tasks of a barrier stage, each joined with the first one by a socket: a barrier's own messages take a second each.

    ``collect`` brings what each task says to the first one, ``tell`` what that one says to each. A task that fails closes its socket, which ends the others.
    """

    def __init__(self):
        context = BarrierTaskContext.get()
        self.part, others = context.partitionId(), len(context.getTaskInfos()) - 1
        server = socket.create_server(("", 0), backlog=others + 1) if self.part == 0 else None
        host = context.getTaskInfos()[0].address.rpartition(":")[0].strip("[]")
        where = context.allGather(f"{host} {server.getsockname()[1]} {secrets.token_hex(16)}" if server else "")[0]
        host, port, secret = where.split(" ")
        if server:
            server.settimeout(300)
            with server:
                self.peers = []
                while len(self.peers) < others:
                    peer = server.accept()[0]
                    peer.settimeout(60)
                    if hmac.compare_digest(self._read(peer, len(secret)), secret.encode()):
                        self._ready(peer)
                        self.peers.append(peer)
                    else:
                        peer.close()
        else:
            peer = socket.create_connection((host, int(port)), 300)
            peer.sendall(secret.encode())
            self._ready(peer)
            self.peers = [peer]

    @staticmethod
    def _ready(peer: socket.socket) -> None:
        peer.settimeout(None)
        peer.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
        peer.setsockopt(socket.SOL_SOCKET, socket.SO_KEEPALIVE, 1)

    @staticmethod
    def _read(peer: socket.socket, n: int) -> bytes:
        got = bytearray()
        while len(got) < n:
            some = peer.recv(min(n - len(got), 1 << 20))
            if not some:
                raise ConnectionError("another task has ended")
            got += some
        return bytes(got)

    def _heard(self, peer: socket.socket) -> bytes:
        return self._read(peer, int.from_bytes(self._read(peer, 8)))

    def _say(self, peer: socket.socket, said: bytes) -> None:
        peer.sendall(len(said).to_bytes(8) + said)

    def collect(self, said: bytes) -> list[bytes] | None:
        if self.part == 0:
            return [said, *map(self._heard, self.peers)]
        self._say(self.peers[0], said)
        return None

    def tell(self, said: bytes) -> bytes:
        if self.part:
            return self._heard(self.peers[0])
        for peer in self.peers:
            self._say(peer, said)
        return said

    def close(self) -> None:
        for peer in self.peers:
            peer.close()


def _together(merges: int, at_least: int, known: tuple[str, ...] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches, pa.schema([("word", pa.string()), ("freq", pa.int64())]))
        words, freq = t["word"].combine_chunks(), t["freq"].to_numpy()
        del t
        with contextlib.closing(Meeting()) as meeting:
            found = learned(words, freq, merges, at_least, known, meeting)
        if meeting.part == 0:
            yield from _merges(found).to_batches()

    return run


def train(words: DataFrame, merges: int, at_least: int = 2, local_words: int = LOCAL_WORDS, write_every: int = 20, known: tuple[str, ...] | None = None) -> DataFrame:
    """Merges (rank, left, right, result) learned from ``words(word, freq)``; ``known`` as in :func:`learn`."""
    words = written(words.select("word", F.col("freq").cast("bigint").alias("freq")).where("word <> '' AND freq > 0"))
    number, parts = words.count(), _barrier_parts(words.sparkSession)
    if number <= local_words:
        return words.withColumn("g", F.lit(0)).groupBy("g").applyInArrow(_one_task(merges, at_least, known), MERGES)
    if number <= local_words * parts:
        return words.repartition(parts).mapInArrow(_together(merges, at_least, known), MERGES, barrier=True)
    symbols, found, last = words.select("freq", tx.codepoints(F.col("word")).alias("s")).where("size(s) > 1"), [], None
    made, new_tokens, rounds, there = set(known or ()), 0, 0, set()
    while new_tokens < merges:
        pairs = symbols.select("freq", F.explode(tx.adjacent_pairs(F.col("s"))).alias("p")).groupBy("p.left", "p.right").agg(F.sum("freq").alias("n"))
        best = [(r["left"], r["right"], r["n"]) for r in counts.best_pairs(pairs.where(F.col("n") >= at_least), ROUND).collect()]
        taken = []
        for left, right, _ in successive(best):
            if new_tokens >= merges:
                break
            taken.append((left, right))
            found.append((len(found), left, right, left + right))
            if known is None or left + right not in made:
                new_tokens += 1
                made.add(left + right)
            if left + right in there:  # its pairs may become more frequent than those that follow
                break
            there.add(left + right)
        if not taken:
            break
        symbols = symbols.select("freq", tx.merged_pairs(F.col("s"), taken).alias("s")).where("size(s) > 1")
        rounds += 1
        if rounds % write_every == 0:
            symbols = written(symbols)
            if last is not None:
                dropped(last)
            last = symbols
    return words.sparkSession.createDataFrame(found, MERGES)


def successive(best: list[tuple[str, str, int]], most: int | None = None) -> list[tuple[str, str, int]]:
    """Of pairs in their order, those that would be merged one after the other before any other pair comes up.

    Pairs without a common symbol don't change each other's counts. A merge makes pairs of the neighbours of its symbols, none more frequent than the
    pair it comes from, which shares a symbol with the merge; so every pair above the first such one is safe. A pair of one symbol with itself may make a more frequent one
    and ends the round; so does the end of the list.
    """
    most = ROUND if most is None else most
    taken, used = [], set()
    for left, right, n in best:
        if used & {left, right}:
            break
        taken.append((left, right, n))
        used |= {left, right}
        if left == right:
            break
    touched = next((n for left, right, n in best[len(taken) :] if used & {left, right}), best[-1][2] if len(best) >= most else 0)
    return [t for i, t in enumerate(taken) if i == 0 or t[2] > touched]


@dataclass
class Tokenizer:
    """Merges and ids, small enough for every task (a vocabulary's size)."""

    ranks: dict[tuple[str, str], int]
    vocab: dict[str, int]

    @classmethod
    def of(cls, base: DataFrame, merges: DataFrame) -> Tokenizer:
        """Every merge takes the next id; a token made twice has the id of its last merge, a pair merged twice its last rank."""
        vocab = {r["token"]: r["id"] for r in base.collect()}
        rows = sorted(merges.collect(), key=lambda r: r["rank"])
        for i, r in enumerate(rows, max(vocab.values(), default=-1) + 1):
            vocab[r["result"]] = i
        return cls({(r["left"], r["right"]): r["rank"] for r in rows}, vocab)

    def pieces(self, word: str) -> list[str]:
        s = list(word)
        if len(s) > LONG_WORD:
            return self._long_pieces(s)
        while len(s) > 1:
            rank, pair = min((self.ranks.get(p, 1 << 30), p) for p in zip(s, s[1:]))
            if rank == 1 << 30:
                break
            s = merged(s, *pair)
        return s

    def _long_pieces(self, s: list[str | None]) -> list[str]:
        """The same by a queue of pairs and links between symbols: its time doesn't grow with the square of the length."""
        n = len(s)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(self.ranks[p], p, i) for i, p in enumerate(zip(s, s[1:])) if p in self.ranks]
        heapq.heapify(queue)
        while queue:
            rank, pair, _ = queue[0]
            made = []
            while queue and queue[0][:2] == (rank, pair):  # all places of a pair, from the left
                i = heapq.heappop(queue)[2]
                j = after[i]
                if j >= n or (s[i], s[j]) != pair:
                    continue
                s[i], s[j] = pair[0] + pair[1], None
                after[i] = after[j]
                if after[j] < n:
                    before[after[j]] = i
                made.append(i)
            for k in {x for i in made for x in (before[i], i)}:
                if k >= 0 and after[k] < n and (p := (s[k], s[after[k]])) in self.ranks:
                    heapq.heappush(queue, (self.ranks[p], p, k))
        return [x for x in s if x is not None]

    def ids(self, word: str) -> list[int]:
        unknown = self.vocab.get("<unk>")
        found = [self.vocab.get(p, unknown) for p in self.pieces(word)]
        if None in found:
            raise KeyError(f"no id for a symbol of {word!r}, and no <unk>")
        return found

    def text(self, ids: Iterable[int]) -> str:
        names = {i: t for t, i in self.vocab.items()}
        return "".join(names[i] for i in ids if i in names and names[i] not in SILENT).replace(tx.MARK, " ")


class Coder:
    """Encodes many words at once, as :meth:`Tokenizer.pieces` does one: in each round every word has its first pair merged wherever it stands.

    Symbols are numbers of ``names``; a character that no name has is ``-2 - ord``. The last words are remembered.
    """

    NONE = np.iinfo(np.int32).max
    #: What stands where a symbol has become part of the one before it.
    GONE = -np.iinfo(np.int32).max

    def __init__(self, tokenizer: Tokenizer, remember: int = 500_000):
        self.tokenizer, self.remember = tokenizer, remember
        order = sorted((rank, pair) for pair, rank in tokenizer.ranks.items())
        self.number = {t: i for i, t in enumerate(dict.fromkeys([*tokenizer.vocab, *(t for _, (a, b) in order for t in (a, b, a + b))]))}
        self.names = pa.array(self.number, pa.string())
        unknown = tokenizer.vocab.get("<unk>", -1)
        self.unknown, self.id = unknown, np.array([tokenizer.vocab.get(t, unknown) for t in self.number], np.int32)
        single = sorted((ord(t), i) for t, i in self.number.items() if len(t) == 1)
        self.letters, self.letter_symbol = (np.array([x[k] for x in single], np.int64) for k in (0, 1))
        key = np.array([self.number[a] << 32 | self.number[b] for _, (a, b) in order], np.int64)
        self.result = np.array([self.number[a + b] for _, (a, b) in order], np.int32)
        self.levels = self._hashed(key)
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.flat, self.begin, self.size = (np.zeros(0, np.int64) for _ in range(3))

    @staticmethod
    def _slot(key: np.ndarray, level: int, bits: int) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * level * 0x632BE59BD9B4E019 & (1 << 64) - 1) >> np.uint64(64 - bits)).view(np.int64)

    def _hashed(self, key: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Tables of keys and their ranks: a key whose slot another one has is in the next table."""
        rank, levels = np.arange(len(key), dtype=np.int32), []
        while len(key) or not levels:
            bits = max(10, (8 * len(key)).bit_length())
            slot = self._slot(key, len(levels), bits)
            own, first = np.unique(slot, return_index=True)
            keys, ranks = np.full(1 << bits, -1), np.full(1 << bits, self.NONE, np.int32)
            keys[own], ranks[own] = key[first], rank[first]
            levels.append((bits, keys, ranks))
            key, rank = np.delete(key, first), np.delete(rank, first)
        return levels

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b  # negative where one is unknown
        bits, keys, ranks = self.levels[0]
        at = self._slot(key, 0, bits)
        there = keys.take(at)
        same = there == key
        out = np.where(same, ranks.take(at), np.int32(self.NONE))
        other = np.flatnonzero((there >= 0) & ~same) if len(self.levels) > 1 else ()
        if len(other):
            key = key[other]
            for level, (bits, keys, ranks) in enumerate(self.levels[1:], 1):
                at = self._slot(key, level, bits)
                out[other] = np.where(keys.take(at) == key, ranks.take(at), out[other])
        return out

    def _block(self, s: np.ndarray) -> np.ndarray:
        """Merges the words in the columns of ``s``, a symbol a row and none in the last row, in place; whether a word has to be encoded another way.

        Each round merges a word's first pair where it first stands. That is the first place of all only while no merge brings up a pair that comes
        before the merged one, as a token made in two ways may.
        """
        n, rows = s.shape[1], len(s) - 1
        place = np.arange(rows + 1, dtype=np.int32)[:, None]
        near = self._ranks(s[:-1].ravel(), s[1:].ravel()).reshape(rows, n)
        first = np.full((rows + 1, n), self.NONE, np.int32)
        first[:-1] = np.where(near == self.NONE, near, near << PLACE | place[:-1])
        after = (place + 1) * n + np.arange(n)
        before = (place - 1) % (rows + 1) * n + np.arange(n)
        s, v, after, before, again = s.reshape(-1), first.reshape(-1), after.reshape(-1), before.reshape(-1), np.zeros(n, bool)
        while True:
            best = first[:-1].min(axis=0)
            word = np.flatnonzero(best != self.NONE)
            if not len(word):
                return again
            best = best[word]
            rank, at = best >> PLACE, best & (1 << PLACE) - 1
            i = at.astype(np.int64) * n + word
            j, p = after.take(i), before.take(i)
            k = after.take(j)
            result = self.result.take(rank)
            s[i], s[j], v[j] = result, self.GONE, self.NONE
            after[i], before[k] = k, i
            right, left = self._ranks(result, s.take(k)), self._ranks(s.take(p), result)
            again[word] |= (right < rank) | (left < rank)
            v[i] = np.where(right == self.NONE, right, right << PLACE | at)
            v[p] = np.where(left == self.NONE, left, left << PLACE | (p // n).astype(np.int32))

    def _short(self, sym: np.ndarray, begin: np.ndarray, size: np.ndarray, which: np.ndarray, done: list) -> np.ndarray:
        """Adds the symbols of the words ``which`` to ``done``; the words that have to be encoded another way."""
        which, left = which[np.argsort(size[which].astype(np.int16), kind="stable")], []
        for k in range(0, len(which), BLOCK):
            own = which[k : k + BLOCK]
            place = np.arange(int(size[own].max()) + 1)[:, None]
            s = np.where(place < size[own], sym.take(np.minimum(begin[own] + place, len(sym) - 1)), np.int32(self.GONE))
            again = self._block(s)
            left.append(own[again])
            got = s[:-1].T
            there = (got != self.GONE) & ~again[:, None]
            done.append((np.repeat(own, there.sum(axis=1)), got[there]))
        return np.concatenate(left) if left else which

    def fresh(self, words: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all words, one word's after the other's, and how many each has."""
        if not isinstance(words, pa.Array):
            words = pa.array(words, pa.string())
        size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        letters = code_points(words).astype(np.int32)
        sym = -2 - letters
        if len(self.letters):
            number = np.full(max(int(letters.max(initial=0)), int(self.letters[-1])) + 1, -1, np.int32)
            number[self.letters] = self.letter_symbol
            sym = np.where((known := number.take(letters)) >= 0, known, sym)
        done, begin = [], np.cumsum(size) - size
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            pieces = [self.number.get(p, -2 - ord(p[0])) for p in self.tokenizer.pieces(words[i].as_py())]
            done.append((np.full(len(pieces), i), np.array(pieces, np.int32)))
        few = (size > 0) & (size <= SHORT_WORD) & (len(self.result) < 1 << 31 - PLACE)
        rest = (size > 0) & (size <= LONG_WORD) & ~few
        rest[self._short(sym, begin, size, np.flatnonzero(few), done)] = True
        w = np.repeat(np.arange(len(words)), size)
        sym, w = sym[rest[w]], w[rest[w]]
        r = np.full(len(sym), self.NONE, np.int32)
        r[:-1] = np.where(w[1:] == w[:-1], self._ranks(sym[:-1], sym[1:]), self.NONE)
        while len(sym):
            start = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            count, best = np.diff(np.r_[start, len(sym)]), np.minimum.reduceat(r, start)
            if (over := best == self.NONE).any():
                out = np.repeat(over, count)
                done.append((w[out], sym[out]))
                sym, w, r, count, best = sym[~out], w[~out], r[~out], count[~over], best[~over]
            hit = np.flatnonzero(r == np.repeat(best, count))
            near = hit[1:] == hit[:-1] + 1
            if near.any():  # of a run every other one, from the left
                k = np.arange(len(hit))
                hit = hit[(k - np.maximum.accumulate(np.where(np.r_[True, ~near], k, 0))) % 2 == 0]
            sym[hit] = self.result[r[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, w, r = sym[keep], w[keep], r[keep]
            at = hit - np.arange(len(hit))
            at = np.concatenate([at, at[at > 0] - 1])
            r[at] = self.NONE
            at = at[at + 1 < len(sym)]
            at = at[w[at] == w[at + 1]]
            r[at] = self._ranks(sym[at], sym[at + 1])
        if not done:
            return sym.astype(np.int64), size
        w, sym = (np.concatenate(x) for x in zip(*done))
        sym = sym.astype(np.int64)
        return sym[np.argsort(w, kind="stable")], np.bincount(w, minlength=len(words))

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`fresh`; words that are remembered aren't encoded again."""
        slot = np.fromiter(map(self.slot.get, words, repeat(-1)), np.int64, len(words))
        if (slot < 0).any():
            if len(self.slot) + int((slot < 0).sum()) > self.remember:
                self._forget()
                slot[:] = -1
            new = np.flatnonzero(slot < 0)
            fresh = [words[i] for i in new.tolist()]
            sym, size = self.fresh(fresh)
            slot[new] = np.arange(len(self.begin), len(self.begin) + len(new))
            self.slot.update(zip(fresh, slot[new].tolist()))
            self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
            self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, sym])
        return taken(self.flat, self.begin[slot], self.size[slot]), self.size[slot]

    def ids(self, sym: np.ndarray) -> np.ndarray:
        if not len(self.id):
            self.id = np.full(1, self.unknown, np.int32)
        out = np.where(sym < 0, self.unknown, self.id[np.maximum(sym, 0)]).astype(np.int32)
        if self.unknown < 0 and (out < 0).any():
            raise KeyError("no id for a symbol, and no <unk>")
        return out

    def texts(self, sym: np.ndarray) -> pa.Array:
        if len(sym) and sym.min() < 0:
            names = self.names.to_pylist()
            return pa.array([names[s] if s >= 0 else chr(-2 - s) for s in sym.tolist()], pa.string())
        return self.names.take(pa.array(sym))


def taken(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``flat``, one after the other."""
    stop = np.cumsum(size)
    return flat[np.repeat(begin - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)]


def _offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())


def _each_once(words: pa.Array, coder: Coder) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of an array of lists of words: which distinct word each is, the lists' sizes, and the symbols of the distinct words with their sizes."""
    found = words.flatten().dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False), *coder(found.dictionary.to_pylist())


def word_ids(tokenizer: Tokenizer):
    """Arrow function: array of pretokens to array of ids; each distinct word of a batch is looked up once, and encoded if a task hasn't met it."""
    coder = None

    @F.arrow_udf(ArrayType(IntegerType()))
    def run(words: pa.Array) -> pa.Array:
        nonlocal coder
        coder = coder or Coder(tokenizer)
        which, sizes, sym, size = _each_once(words, coder)
        ids = taken(coder.ids(sym), (np.cumsum(size) - size)[which], size[which])
        stop = np.concatenate([[0], np.cumsum(size[which])])[np.concatenate([[0], np.cumsum(sizes)])]
        return pa.ListArray.from_arrays(pa.array(stop, pa.int32()), pa.array(ids, pa.int32()), mask=words.is_null())

    return run


def encode(docs: DataFrame, tokenizer: Tokenizer, pretokenize: Callable[[Column], Column] = tx.pretokens) -> DataFrame:
    """``docs`` with ``ids``: one pass, no shuffle."""
    if pretokenize is tx.pretokens:
        return docs.withColumn("ids", _of_texts(tokenizer, docs.sparkSession, "ids")(whole(F.col("text"))))
    return docs.withColumn("ids", word_ids(tokenizer)(pretokenize(F.col("text"))))


def word_pieces(tokenizer: Tokenizer):
    """Arrow function: array of pretokens to the array of each one's pieces."""
    coder = None

    @F.arrow_udf(ArrayType(ArrayType(StringType())))
    def run(words: pa.Array) -> pa.Array:
        nonlocal coder
        coder = coder or Coder(tokenizer)
        which, sizes, sym, size = _each_once(words, coder)
        pieces = pa.ListArray.from_arrays(_offsets(size), coder.texts(sym)).take(pa.array(which))
        return pa.ListArray.from_arrays(_offsets(sizes), pieces, mask=words.is_null())

    return run


FORMS = {"pretokens": "array<string>", "pieces": "array<array<string>>", "tokens": "array<string>", "ids": "array<int>", "decoded": "string"}
#: White space as :data:`text.ANY_SPACE` has it, without the blank, for Arrow's regular expressions.
SPACES = r"\t\n\x0b\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def normalized(texts: pa.Array) -> pa.Array:
    """As :func:`text.normalize_for_roundtrip`; a single blank between words isn't replaced."""
    return pc.utf8_rtrim(pc.replace_substring_regex(texts, f"[{SPACES}][{SPACES} ]*| [{SPACES} ]+", " "), " ")


def _of_texts(tokenizer: Tokenizer, spark: SparkSession, *forms: str):
    """Arrow function: text to one of :data:`FORMS`, or to a struct of several; or to ``decoded`` and whether it is the ``same``. Pretokens are the usual ones, and don't leave the function unless asked for."""
    known, pretokenizer, coder = kinds(spark), None, None
    names = _names(tokenizer) if "decoded" in forms else None

    kind = FORMS | {"same": "boolean"}

    @F.arrow_udf(kind[forms[0]] if len(forms) == 1 else f"struct<{', '.join(f'{x}: {kind[x]}' for x in forms)}>")
    def run(texts: pa.Array) -> pa.Array:
        nonlocal pretokenizer, coder
        pretokenizer, coder = pretokenizer or Pretokenizer(known), coder or Coder(tokenizer)
        null = texts.is_null()
        words, number = pretokenizer(texts)
        found = words.dictionary_encode()
        which, words = found.indices.to_numpy(), marked(found.dictionary).cast(pa.string())
        sym, size = coder.fresh(words)
        if forms in (("decoded",), ("decoded", "same")):  # words are decoded once
            each = pc.binary_join(pa.ListArray.from_arrays(_offsets(size), names.take(pa.array(coder.ids(sym)))), "")
            each = pc.replace_substring(each, tx.MARK, " ").take(pa.array(which))
            joined = pc.binary_join(pa.ListArray.from_arrays(_offsets(number), each, mask=null), "")
            return joined if forms == ("decoded",) else pa.StructArray.from_arrays([joined, pc.equal(joined, normalized(texts))], list(forms))
        at, long = (np.cumsum(size) - size)[which], size[which]
        listed = lambda values, stop: pa.ListArray.from_arrays(pa.array(stop, pa.int32()), values, mask=null)
        by_word, by_text = np.concatenate([[0], np.cumsum(long)]), np.concatenate([[0], np.cumsum(number)])
        by_token, out = by_word[by_text], {}
        if "ids" in forms or "decoded" in forms:
            ids = pa.array(taken(coder.ids(sym), at, long), pa.int32())
            out["ids"] = listed(ids, by_token)
        if "decoded" in forms:
            out["decoded"] = pc.replace_substring(pc.binary_join(listed(names.take(ids), by_token), ""), tx.MARK, " ")
        if "pieces" in forms or "tokens" in forms:
            tokens = coder.texts(taken(sym, at, long))
            out["tokens"] = listed(tokens, by_token)
            out["pieces"] = listed(pa.ListArray.from_arrays(pa.array(by_word, pa.int32()), tokens), by_text)
        if "pretokens" in forms:
            out["pretokens"] = listed(words.take(pa.array(which)), by_text)
        return out[forms[0]] if len(forms) == 1 else pa.StructArray.from_arrays([out[x] for x in forms], list(forms))

    return run


def tokenized(docs: DataFrame, tokenizer: Tokenizer, pretokenize: Callable[[Column], Column] = tx.pretokens) -> DataFrame:
    """``docs`` with ``pretokens``, ``pieces`` (those of each pretoken), ``tokens`` (all of them), ``ids`` and ``decoded``."""
    if pretokenize is tx.pretokens:
        got = docs.withColumn("forms", _of_texts(tokenizer, docs.sparkSession, *FORMS)(whole(F.col("text"))))
        return got.select(*docs.columns, *(F.col(f"forms.{x}") for x in FORMS))
    rows = docs.withColumn("pretokens", pretokenize(F.col("text"))).withColumn("pieces", word_pieces(tokenizer)(F.col("pretokens")))
    rows = rows.withColumn("tokens", F.flatten("pieces")).withColumn("ids", word_ids(tokenizer)(F.col("pretokens")))
    return decoded(rows, tokenizer)


def round_trip(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """``docs`` with ``decoded``, the text that its ids decode to, and ``same``, whether that is all that is kept of its text; the ids aren't moved."""
    got = docs.withColumn("forms", _of_texts(tokenizer, docs.sparkSession, "decoded", "same")(whole(F.col("text"))))
    return got.select(*docs.columns, "forms.decoded", "forms.same")


def served_statistics(docs: DataFrame, tokenizer: Tokenizer, languages: tuple[str, ...] | None = None) -> DataFrame:
    """(language, total_tokens, total_words, ratio): tokens of each language over its faithful units; asked languages without text have zeros.

    Fails where no language has any text.
    """
    units = docs.groupBy("lang").agg(F.sum(tx.faithful_units(F.col("text")).cast("bigint")).alias("total_words"))
    tokens = tallied(docs, tokenizer).groupBy("lang").agg(F.sum("total").alias("total_tokens"))
    got = written(units.join(tokens, "lang", "left").na.fill(0))
    if got.where("total_words > 0").isEmpty():
        raise ValueError("no language has any text to take statistics of")
    if languages is not None:
        got = got.sparkSession.createDataFrame([(x,) for x in languages], "lang string").join(got, "lang", "left").na.fill(0, ["total_words", "total_tokens"])
    ratio = F.coalesce(F.try_divide(F.col("total_tokens").cast("double"), F.col("total_words").cast("double")), F.lit(0.0))
    return got.select(F.col("lang").alias("language"), "total_tokens", "total_words", ratio.alias("ratio"))


def full_report(ratios: DataFrame, vocab_size: int) -> DataFrame:
    """One row: the languages with their totals and ratios, the largest and smallest ratio of those with words, their difference and the score."""
    report = ratio_report(ratios, vocab_size, "total_words", "ratio")
    listed = ratios.agg(F.array_sort(F.collect_list(F.struct("language", "total_tokens", "total_words", "ratio"))).alias("languages"))
    return listed.crossJoin(F.broadcast(report)).select("vocab_size", "languages", "largest_ratio", "smallest_ratio", "difference", "assignment_score")


def language_gate(reports: DataFrame, language: str = "en", most: float = 1.2) -> DataFrame:
    """(language, fertility, most, met): whether the language's fertility is within the target; no row without words."""
    return reports.where((F.col("language") == language) & (F.col("num_words") > 0)).select("language", "fertility", F.lit(most).alias("most"), (F.col("fertility") <= most).alias("met"))


def summary(reports: DataFrame) -> DataFrame:
    """A line of text for each language of a report."""
    rate = lambda c: F.format_string("%.3f%%", F.col(c) * 100)
    line = F.format_string("%-10s %6d %8d %10.3f %9s %12.3f %10s %10s", "language", "num_documents", "num_words", "fertility", rate("unk_rate"), "compression_ratio", F.when(F.col("roundtrip_ok"), "OK").otherwise("FAIL"), rate("vocab_utilization"))
    return reports.select("language", line.alias("line"))


def _names(tokenizer: Tokenizer) -> pa.Array:
    """What each id decodes to; the last one is that of all other ids."""
    names = [""] * (max(tokenizer.vocab.values(), default=-1) + 2)
    for t, i in tokenizer.vocab.items():
        names[i] = "" if t in SILENT else t
    return pa.array(names, pa.string())


def _joined(tokenizer: Tokenizer):
    names = _names(tokenizer)

    @F.arrow_udf("string")
    def run(ids: pa.Array) -> pa.Array:
        at = ids.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
        at = np.where((at < 0) | (at >= len(names)), len(names) - 1, at)
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        return pc.binary_join(pa.ListArray.from_arrays(_offsets(sizes), names.take(pa.array(at)), mask=ids.is_null()), "")

    return run


def decoded(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """``docs(ids)`` with ``decoded``: unknown and silent ids go."""
    return docs.withColumn("decoded", F.replace(_joined(tokenizer)(F.col("ids")), F.lit(tx.MARK), F.lit(" ")))


def _tallied(tokenizer: Tokenizer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sums, used = Coder(tokenizer), {}, {}
        for b in batches:
            sym, size = coder.fresh(b["word"])
            ids, freq = coder.ids(sym), b["freq"].to_numpy()
            word = np.repeat(np.arange(len(size)), size)
            unknown = np.bincount(word[ids == coder.unknown], minlength=len(size))
            plain = np.where(b["plain"].to_numpy(zero_copy_only=False), freq, 0)
            lang = b["lang"].dictionary_encode("encode")
            which = lang.indices.to_numpy()
            for k, name in enumerate(lang.dictionary.to_pylist()):
                own = which == k
                now = [int(x[own].sum()) for x in (plain, plain * size, freq * size, freq * unknown)]
                sums[name] = [x + y for x, y in zip(sums.get(name, (0, 0, 0, 0)), now)]
                used[name] = np.union1d(used.get(name, np.zeros(0, np.int32)), ids[own[word]])
        columns = [[x[k] for x in sums.values()] for k in range(4)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), *(pa.array(c, pa.int64()) for c in columns), pa.array([used[k].tolist() for k in sums], pa.list_(pa.int32()))],
            ["lang", "num_words", "num_tokens", "total", "num_unk_tokens", "used"],
        )

    return run


def tallied(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """Rows of (lang, num_words, num_tokens, total, num_unk_tokens, used), of each task one a language: sums over its distinct words, and the ids among them."""
    words = counts.language_words(docs).withColumn("plain", tx.is_word_like(F.col("word")))
    return words.mapInArrow(_tallied(tokenizer), "lang string, num_words bigint, num_tokens bigint, total bigint, num_unk_tokens bigint, used array<int>")


def evaluate(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """A report row for each language of ``docs(lang, text)``. Only distinct words are encoded, each once a language."""
    tally = written(tallied(docs, tokenizer))
    words = tally.groupBy("lang").agg(*(F.sum(c).alias(c) for c in ("num_words", "num_tokens", "total", "num_unk_tokens")))
    used = tally.select("lang", F.explode("used").alias("id")).distinct().groupBy("lang").agg(F.count("*").alias("used"))
    names = {i: t for t, i in tokenizer.vocab.items()}
    kept = docs.select("lang", "text", F.coalesce(tx.joined_pretokens(F.col("text")), F.lit("")).alias("joined"))
    # a text comes back as its pretokens unless one of its characters has no id
    known = "[" + "".join(rf"\x{{{ord(t):x}}}" for t in names.values() if len(t) == 1) + "]*"
    back = F.col("joined").rlike(f"^{known}$") & (F.replace("joined", F.lit(tx.MARK), F.lit(" ")) == tx.normalize_for_roundtrip(F.col("text")))
    texts = kept.groupBy("lang").agg(
        F.count("*").alias("num_documents"), F.sum(F.length("text").cast("bigint")).alias("num_chars"),
        F.sum(F.when(back, 0).otherwise(1)).cast("bigint").alias("roundtrip_mismatches"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    out = texts.join(words, "lang", "left").join(used, "lang", "left").na.fill(0)
    return out.select(
        F.col("lang").alias("language"), "num_documents", "num_words", "num_tokens", ratio("num_tokens", "num_words").alias("fertility"),
        "num_unk_tokens", ratio("num_unk_tokens", "total").alias("unk_rate"), "num_chars", ratio("total", "num_chars").alias("compression_ratio"),
        "roundtrip_mismatches", (F.col("roundtrip_mismatches") == 0).alias("roundtrip_ok"), (F.col("used") / len(tokenizer.vocab)).alias("vocab_utilization"),
    )


def ratio_report(reports: DataFrame, vocab_size: int, words: str = "num_words", ratio: str = "fertility") -> DataFrame:
    """One row: largest and smallest ratio of languages with words, their difference, the score as text, the fertility spread."""
    has = F.col(words) > 0
    got = reports.agg(F.coalesce(F.max(F.when(has, F.col(ratio))), F.lit(0.0)).alias("largest_ratio"), F.coalesce(F.min(F.when(has, F.col(ratio))), F.lit(0.0)).alias("smallest_ratio"), F.sum(has.cast("int")).alias("n"))
    got = got.withColumn("difference", F.col("largest_ratio") - F.col("smallest_ratio"))
    score = F.when(F.col("difference") == 0, "Infinity").otherwise((1000 / F.nullif("difference", F.lit(0.0))).cast("string"))
    return got.select(F.lit(vocab_size).alias("vocab_size"), "largest_ratio", "smallest_ratio", "difference", score.alias("assignment_score"), F.when(F.col("n") >= 2, F.col("difference")).otherwise(0.0).alias("spread"))
