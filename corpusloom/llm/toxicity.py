"""Toxic terms by Levenshtein automata intersected with the lexicon's trie, scored in their context.

Each distinct word's automaton is walked along the trie of all terms, for many words at once, so a word costs as much as there are
nodes near it, and nothing is built of all terms' automata beforehand. Edits are insertions, deletions, substitutions
and swaps of neighbours; short terms allow none, middle ones one, long ones two, and the first letter must be
right. A hit's score is the term's weight, less for misspellings, less again where the words around it report
or quote it, more where they address someone. A document is toxic from the score ``threshold`` of one hit, or
from that of several weak ones together.

Labelled documents add terms of their own: words that occur in a ``RATIO`` times greater share of toxic than of
clean documents, near-duplicates counted once. They stand in the trie with the same tolerance, and prove something only by their
number: the hits of a passage of ``PASSAGE`` words, or of the whole text, those in quotations or misspelled counted less, are held
against the rates at which toxic and clean documents use such terms, and the posterior must reach ``SURE``. Forms near a
term that clean labelled documents use are ordinary words.

Defined results: null and empty texts have no hits. A null doc_id is reported as null. Repeated rows are
reported each. Of two terms equally near a word the one with the greater weight, then the first in
alphabetical order, is named. A letter beyond ASCII counts as one letter. Without labels of both kinds only the
lexicon is used. Conflicting labels of an id are averaged; labels without a document tell nothing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import read_table, written
from corpusloom.llm.simhash_dedup import keep_one
from corpusloom.llm.words import as_texts, chunks, words

_PLAIN = """
idiot:1 idiots:1 idiotic:.9 moron:1 morons:1 moronic:.9 imbecile:1 cretin:1 stupid:.9 dumbass:1 dumb:.6 loser:.9 losers:.9
scum:1 scumbag:1 trash:.8 garbage:.6 worthless:.9 pathetic:.9 disgusting:.9 disgrace:.7 clown:.8 clowns:.8 filthy:.8 vermin:1
retard:1 retarded:1 bastard:1 bitch:1 asshole:1 shithead:1 bullshit:.8 fuck:1 fucking:1 fucker:1 motherfucker:1 dickhead:1
wanker:1 prick:.8 cunt:1 whore:1 slut:1 twat:1 jackass:1 degenerate:.8 despicable:.8 repulsive:.8 parasite:.7 lowlife:.9
dummkopf:1 vollidiot:1 arschloch:1 blödmann:1 abschaum:1 drecksau:1 trottel:.9 schlampe:1 hurensohn:1 missgeburt:1
connard:1 connasse:1 salaud:1 salope:1 crétin:1 abruti:1 imbécile:1 enculé:1 ordure:.8 débile:.9
imbécil:1 estúpido:.9 estúpida:.9 gilipollas:1 cabrón:1 pendejo:1 idiota:1 escoria:1 asqueroso:.9 maricón:1
"""
LEXICON: dict[str, float] = {t: float(w) for t, w in (x.split(":") for x in _PLAIN.split())}
#: Ordinary words that lie within the edits of a term.
ORDINARY = frozenset(
    "crown crowns clone clones cloud clouds close closer lose loses loner loners lower layer laser lasers poser stupor trashy thrash "
    "morons moran mormon macron idiom idioms prick brick trick pluck rebate retard retards regard regards reward rewarded retired record "
    "recorded restart restarted batch hitch birch witch bench filth worth cabin prank wanders wander wonder wanker parasites garage "
    "cartage disgracefully discussing digesting pathetically sympathetic cretan certain curtain imbue slum stump disguise disgust "
    "generate regenerate impulsive repulse pulsive salad salaud salade ordre ordures estudio estupendo estudia pendiente cabello "
    "gardening connard canard couard combat verming termin worthiness trotter schlamm idiotas idioma".split()
) - set(LEXICON)
#: Labelled documents that terms are learned from, at most: those with the least hash of their id.
TRAIN_ROWS = 20_000
#: Toxic documents a learned term is in, at least, and how much greater its share of them is than of clean ones.
TERM_DOCS = 5
RATIO = 8.0
SURE = 0.9
#: Words of a passage that learned terms are counted in.
PASSAGE = 256
#: Different contexts that show a form to be an ordinary word, and the share of them with abuse that a misspelling has.
ORDINARY_CONTEXTS, ORDINARY_ABUSE = 8, 0.2
#: Words whose terms a task remembers, by a part of their hash (a power of 2).
_CACHE = 20


def allowed(term: str) -> int:
    return 0 if len(term) <= 4 else 1 if len(term) <= 7 else 2


def edits(a: str, b: str) -> int:
    """Edit distance with swaps of neighbours, which no other edit touches."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, rows[-2][j - 2] + 1)
            row.append(d)
        rows.append(row)
    return rows[-1][-1]


#: The automaton's states are rows of distances to the word's prefixes that are at most so much longer or shorter than the term's.
_BAND = 2
_FAR = 9


class Trie:
    """The terms as a trie, walked with the Levenshtein automata of many words at once.

    A node's entry for a word is the state of that word's automaton after the node's letters: the distances of the letters to the
    word's prefixes within ``_BAND``. A word goes no further down where all distances exceed what the terms below allow, so
    its cost is the number of nodes near it; no automaton is built beforehand.
    """

    def __init__(self, weights: dict[str, float]):
        self.terms = sorted(weights)
        self.weight = np.array([weights[t] for t in self.terms])
        self.longest = max(map(len, self.terms), default=0) + _BAND
        self.alphabet = np.array(sorted({ord(c) for t in self.terms for c in t}), np.uint32)
        code = {chr(c): i + 1 for i, c in enumerate(self.alphabet.tolist())}
        root: dict = {}
        for k, t in enumerate(self.terms):
            node = root
            for c in t:
                node = node.setdefault(c, {})
            node[None] = k
        first, count, letter, term, up, level = [], [], [0], [], [-1], [root]
        for v, node in enumerate(level):
            term.append(node.get(None, -1))
            first.append(len(level))
            for c in sorted(x for x in node if x is not None):
                level.append(node[c])
                letter.append(code[c])
                up.append(v)
            count.append(len(level) - first[-1])
        self.first, self.count, self.letter, self.term = (np.array(x, np.int32) for x in (first, count, letter, term))
        self.limit = np.array([allowed(t) for t in self.terms], np.int8)
        most = [int(self.limit[k]) if k >= 0 else 0 for k in term]
        for v in range(len(level) - 1, 0, -1):
            most[up[v]] = max(most[up[v]], most[v])
        self.most = np.array(most, np.int8)
        below = [1 << min(len(self.terms[k]), 63) if k >= 0 else 0 for k in term]  # the lengths of the terms from a node on
        for v in range(len(level) - 1, 0, -1):
            below[up[v]] |= below[v]
        self.lengths = np.array(below, np.uint64)
        self.root = np.zeros(len(self.alphabet) + 1, np.int32)  # the root's child by letter
        for v in range(first[0], first[0] + count[0]):
            self.root[letter[v]] = v

    def near(self, words: list[str], step: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
        """The best term of each word, or -1, and its edits: the fewest, then the greatest weight, then the first in the alphabet."""
        term, edit = np.full(len(words), -1, np.int32), np.zeros(len(words), np.int8)
        for a in range(0, len(words), step):
            w, t, d = self._walked(words[a : a + step])
            order = np.lexsort((t, -self.weight[t], d, w))
            w, t, d = w[order], t[order], d[order]
            top = np.flatnonzero(np.r_[True, w[1:] != w[:-1]]) if len(w) else np.zeros(0, np.int64)
            term[a + w[top]], edit[a + w[top]] = t[top], d[top]
        return term, edit

    def _walked(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, term, edits) of all terms within their edits of each word that begin with its first letter."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8)
        if not words or not self.terms:
            return none
        most = max(1, max(map(len, words)))
        spelled = np.array(words, f"U{most}").view(np.uint32).reshape(len(words), most)
        size = (spelled != 0).sum(axis=1)
        at = np.minimum(np.searchsorted(self.alphabet, spelled), len(self.alphabet) - 1)
        ids = np.zeros((len(words), self.longest + most + 2 * _BAND + 4), np.int32)
        lead = _BAND + 1
        ids[:, lead : lead + most] = np.where(self.alphabet[at] == spelled, at + 1, 0)
        w = np.flatnonzero((size > 0) & (size <= self.longest))
        node = self.root[ids[w, lead]]
        w, node = w[node > 0], node[node > 0]
        fit = np.array([sum({1 << min(k, 63) for k in range(n - _BAND, n + _BAND + 1) if k > 0}) for n in range(self.longest + 1)], np.uint64)
        width = 2 * _BAND + 1
        old = np.tile(np.array([_FAR] * _BAND + list(range(_BAND + 1)), np.int8), (len(w), 1))
        older, before = np.full_like(old, _FAR), np.zeros(len(w), np.int32)
        found, j = [], 0
        while len(w):
            c, n = self.letter[node], size[w]
            row = np.full((len(w), width), _FAR, np.int8)
            for k in range(width):
                i = j + 1 + k - _BAND  # letters of the word that this distance is for
                if i < 0:
                    continue
                best = old[:, k + 1] + 1 if k + 1 < width else np.full(len(w), _FAR, np.int8)
                if i:
                    last = ids[w, lead + i - 1]
                    best = np.minimum(best, old[:, k] + (last != c))
                    if k:
                        best = np.minimum(best, row[:, k - 1] + 1)
                    if i > 1 and j:
                        swap = (last == before) & (ids[w, lead + i - 2] == c)
                        best = np.where(swap, np.minimum(best, older[:, k] + 1), best)
                row[:, k] = np.where(i <= n, np.minimum(best, _FAR), _FAR)
            t = self.term[node]
            k = n - (j + 1) + _BAND
            end = np.flatnonzero((t >= 0) & (k >= 0) & (k < width))
            d = row[end, k[end]]
            ok = d <= self.limit[t[end]]
            found.append((w[end[ok]], t[end[ok]], d[ok]))
            # down to all children
            live = np.flatnonzero((row.min(axis=1) <= self.most[node]) & (self.count[node] > 0))
            many = self.count[node[live]]
            rep = np.repeat(live, many)
            child = self.first[node[rep]] + np.arange(len(rep)) - np.repeat(np.cumsum(many) - many, many)
            keep = (self.lengths[child] & fit[size[w[rep]]]) != 0
            rep, child = rep[keep], child[keep]
            w, before, older, old, node, j = w[rep], c[rep], old[rep], row[rep], child, j + 1
        return tuple(np.concatenate(x) for x in zip(*found)) if found else none


class Finder:
    """The terms near the words of many texts; each distinct word is looked up once and remembered."""

    def __init__(self, trie: Trie, ordinary: frozenset[str] = frozenset()):
        self.trie, self.ordinary = trie, ordinary
        self.known, self.answer = np.zeros(1 << _CACHE, np.uint64), np.full(1 << _CACHE, -1, np.int32)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, object]:
        """Of each word that is near a term: its text, its number there, the term and the edits; and the words."""
        w = words(texts)
        at = np.flatnonzero((w.end - w.start) <= 4 * self.trie.longest)
        h = w.hash[at]
        place = (h >> np.uint64(64 - _CACHE)).astype(np.int64)
        answer = np.where(self.known[place] == h, self.answer[place], -2)
        miss = np.flatnonzero(answer == -2)
        if len(miss):
            keys, first, which = np.unique(h[miss], return_index=True, return_inverse=True)
            spelled = [bytes(w.buf[a:b]).decode() for a, b in zip(w.start[at[miss[first]]].tolist(), w.end[at[miss[first]]].tolist())]
            term, d = self.trie.near(spelled)
            got = np.where(term >= 0, term * 4 + d, -1).astype(np.int32)
            for i in np.flatnonzero(d > 0).tolist():
                if spelled[i] in self.ordinary:
                    got[i] = -1
            answer[miss] = got[which]
            place = (keys >> np.uint64(64 - _CACHE)).astype(np.int64)
            self.known[place], self.answer[place] = keys, got
        hit = at[answer >= 0]
        answer = answer[answer >= 0]
        doc = np.searchsorted(w.first, hit, "right") - 1
        return doc, hit - w.first[doc], answer >> 2, answer & 3, w


_WORD = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")
_REPORT = frozenset(
    "said says say saying called calls call quoted quotes quote wrote writes word words term terms slur slurs insult insults insulted insulting "
    "shouted yelled accused described labelled labeled phrase comment comments tweet reported reportedly allegedly "
    "sagte sagt nannte schrieb wort beleidigung zitat dit disait appelé écrit mot insulte dijo dice llamó escribió palabra insulto".split()
)
_ADDRESS = frozenset("you your you're youre u ur are're du dich dein deine ihr euch tu vous toi votre tú usted eres".split())
_OPEN, _CLOSE = "\"“„«‘'‹", "\"”“»’'›"
WINDOW = 8


def _quoted(text: str, a: int, b: int, lo: int, hi: int) -> bool:
    """Whether quotation marks stand on both sides within the window, closer than any end of a sentence on the left."""
    left = max(text.rfind(q, lo, a) for q in _OPEN)
    right = [p for q in _CLOSE if (p := text.find(q, b, hi)) >= 0]
    if left < 0 or not right:
        return False
    before_ok = left == 0 or not text[left - 1].isalnum()
    after = min(right)
    return before_ok and (after + 1 >= len(text) or not text[after + 1].isalnum()) and "\n" not in text[left:after]


def scored(text: str, hits: list[tuple[int, str, int]], lexicon: dict[str, float], exact: frozenset = frozenset()) -> list[tuple[int, int, str, int, float, int, bool, int]]:
    """(start, end, term, edits, score, word number, whether abuse is around it, hash of the words around it) of the words ``hits``: number, term and edits."""
    spans = [m.span() for m in _WORD.finditer(text)]
    out = []
    for k, term, d in hits:
        a, b = spans[k]
        near = spans[max(0, k - WINDOW) : k + WINDOW + 1]
        around = {text[x:y].lower() for x, y in near if (x, y) != (a, b)}
        score = lexicon.get(term, 1.0) * (1.0, 0.7, 0.35)[d]
        report = bool(around & _REPORT)
        if _quoted(text, a, b, near[0][0] - 1 if near[0][0] else 0, min(len(text), near[-1][1] + 1)):
            score *= 0.2 if report else 0.5
        elif report:
            score *= 0.6
        if around & _ADDRESS:
            score *= 1.3
        abuse = any(w in _ADDRESS or w in exact or w in lexicon for w in around)
        context = " ".join(text[x:y].lower() for x, y in spans[max(0, k - 3) : k + 4])
        out.append((a, b, term, d, round(score, 4), k, abuse, int.from_bytes(blake2b(context.encode(), digest_size=8).digest(), "little", signed=True)))
    return out


HITS = "array<struct<start:int,end:int,term:string,edits:int,score:double>>"
_SCAN = "uid bigint, doc_id bigint, words bigint, start int, end int, form string, term string, edits int, score double, at bigint, abuse boolean, context bigint"
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.bool_(), pa.int64()]


@dataclass
class Learned:
    """Terms learned from labels, with how many of them a word of toxic and of clean documents makes, and the share of toxic ones."""

    terms: frozenset[str]
    toxic_rate: float = 1.0
    clean_rate: float = 1.0
    prior: float = 0.5
    #: forms near a term that clean documents use, too
    ordinary: frozenset[str] = frozenset()


NOTHING = Learned(frozenset())


def _near_terms(trie: Trie):
    @F.arrow_udf("boolean")
    def run(forms: pa.Array) -> pa.Array:
        term, d = trie.near([x if len(x) <= trie.longest else "" for x in forms.to_pylist()])
        return pa.array((term >= 0) & (d > 0))

    return run


def learn(docs: DataFrame, labels: DataFrame, lexicon: dict[str, float] | None = None, train_rows: int = TRAIN_ROWS, term_docs: int = TERM_DOCS, ratio: float = RATIO) -> Learned:
    """Terms that tell toxic from clean documents, of at most ``train_rows`` labelled ones, and forms near a term that are ordinary words:
    in two clean documents or more, and not in a ``ratio`` times greater share of the toxic ones. Near-duplicates count once.
    """
    sample = (
        labels.select(F.col("doc_id").cast("bigint").alias("__loom_id"), F.col("toxic").cast("double").alias("t"))
        .where("__loom_id IS NOT NULL AND t IS NOT NULL")
        .groupBy("__loom_id").agg((F.avg("t") >= 0.5).cast("int").alias("toxic"))
        .orderBy(F.xxhash64("__loom_id"), "__loom_id").limit(train_rows)
    )
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    rows = written(rows.join(F.broadcast(sample), F.col("doc_id") == F.col("__loom_id")).select("doc_id", "text", "toxic"))
    rows = keep_one(rows).select("toxic", F.regexp_extract_all(F.lower("text"), F.lit(r"[0-9a-z\x{80}-\x{10ffff}]+"), F.lit(0)).alias("w"))
    rows = written(rows)
    size = {r["toxic"]: r for r in rows.groupBy("toxic").agg(F.count("*").alias("n"), F.sum(F.size("w")).alias("words")).collect()}
    if len(size) < 2 or not (size[0]["words"] and size[1]["words"]):
        return NOTHING
    share = lambda c, t: (c + 0.5) / (size[t]["n"] + 1)
    used = written(
        rows.select("toxic", F.explode(F.array_distinct("w")).alias("w"))
        .groupBy("w").agg(F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0"))
    )
    telling = share(F.col("n1"), 1) >= ratio * share(F.col("n0"), 0)
    found = used.where((F.col("n1") >= term_docs) & (F.length("w") >= 3) & telling)
    terms = frozenset(r["w"] for r in found.select("w").collect())
    trie = Trie(dict.fromkeys(terms, 1.0) | (lexicon or {}))
    ordinary = frozenset(r["w"] for r in used.where((F.col("n0") >= 2) & ~telling & (F.length("w") <= trie.longest)).where(_near_terms(trie)("w")).select("w").collect())
    if not terms:
        return Learned(terms, ordinary=ordinary)
    uses = dict(rows.select("toxic", F.explode("w").alias("w")).join(F.broadcast(found.select("w")), "w").groupBy("toxic").count().collect())
    rate = [(uses.get(t, 0) + 0.5) / (size[t]["words"] + 1) for t in (0, 1)]
    return Learned(terms, rate[1], rate[0], size[1]["n"] / (size[0]["n"] + size[1]["n"]), ordinary) if rate[1] > rate[0] else Learned(frozenset(), ordinary=ordinary)


def _scan(lexicon: dict[str, float], trie: Trie, ordinary: frozenset[str], exact: frozenset[str] = frozenset()):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(trie, ordinary)
        uid = TaskContext.get().partitionId() << 40
        for whole, i, j in ((b, i, j) for b in batches for i, j in chunks(as_texts(b["text"]))):
            b = whole.slice(i, j - i)
            doc, number, term, d, w = finder(b["text"])
            near = list(zip(number.tolist(), (trie.terms[t] for t in term.tolist()), d.tolist()))
            rows = []
            cut = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else []
            for i, j in zip(cut, [*cut[1:], len(doc)]):
                at = int(doc[i])
                text, key = b["text"][at].as_py(), b["doc_id"][at].as_py()
                for h in scored(text, near[i:j], lexicon, exact):
                    rows.append((uid + at, key, int(w.first[at + 1] - w.first[at]), h[0], h[1], text[h[0] : h[1]].lower(), *h[2:]))
            uid += len(b)
            cols = zip(*rows) if rows else [[]] * len(_KINDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS)], [c.split()[0] for c in _SCAN.split(", ")])

    return run


def toxic(docs: DataFrame, labels: DataFrame | None = None, lexicon: dict[str, float] | None = None, threshold: float = 0.4, **learning) -> DataFrame:
    """(doc_id, score, hits) of the toxic rows. The texts are read once; only hits are shuffled.

    A form that isn't a term itself counts as an ordinary word, and not as a misspelling, where it stands in
    ``ORDINARY_CONTEXTS`` different contexts of three words on each side, so that copies and near-copies count once, and
    a share below ``ORDINARY_ABUSE`` of them has an address, a term or a learned term within :data:`WINDOW` words.

    :param labels: labels to learn terms from (:func:`learn`)
    :param lexicon: terms in lower case with their weights, 1 for the worst
    """
    lexicon = LEXICON if lexicon is None else lexicon
    known = NOTHING if labels is None else learn(docs, labels, lexicon, **learning)
    own = known.terms - set(lexicon)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not lexicon and not own:
        return rows.where("false").select("doc_id", F.lit(0.0).alias("score"), F.lit(None).cast(HITS).alias("hits"))
    trie = Trie(dict.fromkeys(own, 1.0) | lexicon)
    hits = written(rows.where("text IS NOT NULL").mapInArrow(_scan(dict(lexicon), trie, ORDINARY | known.ordinary, own), _SCAN))
    seen = hits.where("edits > 0").select("form", "context", "abuse").distinct()
    ordinary = seen.groupBy("form").agg(F.count("*").alias("n"), F.avg(F.col("abuse").cast("int")).alias("share")).where((F.col("n") >= ORDINARY_CONTEXTS) & (F.col("share") < ORDINARY_ABUSE)).select("form")
    in_lexicon = F.col("term").isin(sorted(lexicon)) if lexicon else F.lit(False)
    near = hits.join(ordinary, "form", "left_anti").withColumn("worst", F.when(in_lexicon, F.col("score")).otherwise(0.0))
    odds = math.log(known.prior / (1 - known.prior)) if own else 0.0
    # a passage is judged by itself, so that the text around it can't clear it; a text below its length is one passage
    passage = Window.partitionBy("uid").orderBy("at").rangeBetween(0, PASSAGE - 1)
    near = near.withColumn("proof", F.sum(F.least(F.lit(1.0), "score")).over(passage))
    ratio, gap = math.log(known.toxic_rate / known.clean_rate), known.toxic_rate - known.clean_rate
    proof = F.greatest(F.max("proof") * ratio - F.max(F.least("words", F.lit(PASSAGE))) * gap, F.sum(F.least(F.lit(1.0), "score")) * ratio - F.max("words") * gap)
    whole = near.groupBy("uid").agg(
        F.first("doc_id").alias("doc_id"), F.max("worst").alias("top"),
        F.round(1 - F.exp(F.sum(F.log(1 - F.least(F.lit(0.99), F.col("worst"))))), 4).alias("score"),
        F.round(1 / (1 + F.exp(-proof - odds)), 4).alias("posterior") if own else F.lit(0.0).alias("posterior"),
        F.array_sort(F.collect_list(F.struct("start", "end", "term", "edits", "score"))).alias("hits"),
    )
    bad = (F.col("top") >= threshold) | (F.col("score") >= min(0.9, 2 * threshold)) | (F.col("posterior") >= SURE)
    return whole.where(bad).select("doc_id", F.greatest("score", "posterior").alias("score"), "hits")


def op9_toxicity(spark, sf_dir):
    return toxic(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLES: dict[str, str] = {}
