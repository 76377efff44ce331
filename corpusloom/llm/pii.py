"""Personal data found through disguises, with spans in the original characters.

Transducers rewrite a text and carry, for every character they emit, the source span it came from:
invisible characters go and look-alike letters and digits become ASCII; digits spelled out one by one become
figures; "(at)", "[dot]" and their kin become @ and full stops. Identifiers are detected in the rewritten
text and their spans composed back to the source.

Kinds: email, iban, ssn, ip, card (13 to 19 digits that pass the Luhn test), number (as long, failing it) and
phone (7 to 12 digits spelled out one by one, too). ``disguised`` says that the source differs from the value.

Defined results: null and empty texts have no findings. A null doc_id is reported as null. Repeated rows
are reported each. Of overlapping findings the first kind in the list above is reported. Spans are
[start, end) in Unicode characters. Names and addresses have no greatest length.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import read_table
from corpusloom.llm.words import Spans, as_texts

SCHEMA = "doc_id bigint, kind string, value string, start int, end int, disguised boolean"

_LOOKALIKES = dict(
    zip(
        "асеорхуіјѕԁԛԝһӏАВЕКМНОРСТХУІЈЅαοινρτυκΑΒΕΖΗΙΚΜΝΟΡΤΥΧɑɡıⅰⅼ＠﹫．。․‧∙•－–—‑‒−",
        "aceopxyijsdqwhlABEKMHOPCTXYIJSaoivptukABEZHIKMNOPTYXagiil@@......------",
    )
)
_INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff"
for _c in [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B), *range(0x1D400, 0x1D800), 0xFF0B, 0xFF08, 0xFF09, *range(0x660, 0x66A), *range(0x6F0, 0x6FA), *range(0x966, 0x970), *range(0x2080, 0x208A), 0xB2, 0xB3, 0xB9]:
    _n = unicodedata.normalize("NFKC", chr(_c))
    if len(_n) == 1 and not _n.isascii() and (_d := unicodedata.digit(_n, None)) is not None:
        _n = str(_d)
    if len(_n) == 1 and _n.isascii():
        _LOOKALIKES[chr(_c)] = _n
_LOOKALIKES |= {chr(c): " " for c in (0xA0, 0x2007, 0x2009, 0x202F)}
_STRANGE = re.compile("[" + re.escape("".join(_LOOKALIKES)) + _INVISIBLE + "]")

_DIGITS = {
    w: str(d)
    for d, ws in enumerate(
        ["zero oh null zéro cero", "one eins un uno", "two zwei zwo deux dos", "three drei trois tres", "four vier quatre cuatro",
         "five fünf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve"]
    )
    for w in ws.split()
}
_DIGIT = "(?:" + "|".join(sorted(_DIGITS, key=len, reverse=True)) + "|\\d)"
_GAP = r"[ \t,.\-/]{1,3}"
#: Seven or more digits one by one, at least three of them spelled; a repeated word alone is no number.
_SPELLED = re.compile(rf"(?<![^\W_]){_DIGIT}(?:{_GAP}{_DIGIT}){{6,}}(?![^\W_])", re.I)
_ONE = re.compile(_DIGIT, re.I)
_AT = r"(?:\s*[\[({<]\s*(?:at|@|ät|arroba|arobase)\s*[\])}>]\s*|\s+(?:at|arroba|arobase|klammeraffe)\s+|\s*@\s*|\s*&#0*64;\s*|\s*%40\s*)"
_DOT = r"(?:\s*[\[({<]\s*(?:dot|\.|punkt|punto|point)\s*[\])}>]\s*|\s+(?:dot|punkt|punto|point)\s+|\.|\s*&#0*46;\s*|\s*%2[eE]\s*)"
_NAME = r"[A-Za-z0-9](?:[A-Za-z0-9_%+\-]*[A-Za-z0-9])?"
_DOMAIN = re.compile(rf"{_NAME}(?:{_DOT}{_NAME})*{_DOT}[A-Za-z]{{2,24}}(?![A-Za-z0-9])", re.I)
#: What stands before an at, read backwards.
_TOD = r"(?:\s*[\])}>]\s*(?:tod|\.|tknup|otnup|tniop)\s*[\[({<]\s*|\s+(?:tod|tknup|otnup|tniop)\s+|\.|\s*;640*#&\s*|\s*[eE]2%\s*)"
_EMAN = r"[A-Za-z0-9](?:[A-Za-z0-9_%+\-]*[A-Za-z0-9])?"
_LOCAL_BACKWARDS = re.compile(rf"{_EMAN}(?:{_TOD}{_EMAN})*(?![A-Za-z0-9._%+\-@])", re.I)
_AT_IN, _DOT_IN = re.compile(_AT, re.I), re.compile(_DOT, re.I)
_PLAIN_AT = re.compile(r"\s+(?:at|arroba|arobase|klammeraffe)\s+\Z", re.I)

#: Last labels that make a bare "at" an address; bracketed ones need no such proof.
_DOMAINS = frozenset("com org net edu gov mil int info biz io co me dev app eu uk us ca au de at ch fr es it nl be pt pl se no dk fi cz ie br mx ar cl in jp cn ru example test".split())
_DETECT = [
    ("email", re.compile(r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]*@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,24}(?![A-Za-z0-9])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("ssn", re.compile(r"(?<![\d\-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d\-])")),
    ("ip", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)")),
    ("card", re.compile(r"(?<![A-Za-z\d.+\-])\d(?:[ \-]?\d){12,18}(?![A-Za-z\d\-])")),
    ("phone", re.compile(r"(?<![\d.+\-A-Za-z])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .\-]\d{4}|(?:1[ .\-])?\d{3}[ .\-]\d{3}[ .\-]\d{4}|0\d{2,4}[ /\-]\d{3,4}[ \-]?\d{3,5}|00\d{8,13})(?![\d\-])")),
]
_BARE = re.compile(r"(?<!\d)\d{7,12}(?!\d)")
_RANK = {k: i for i, k in enumerate(["email", "iban", "ssn", "ip", "card", "number", "phone"])}
_SPELLED_ALT = "|".join(re.escape(w) for w in sorted(_DIGITS, key=len, reverse=True))
#: White space and gaps as they are before look-alikes are replaced; RE2's own class is ASCII's.
_S = "[\\s\\p{Z}\\x0b\\x1c-\\x1f\\x85]"
_GAPS = "[\\p{Z}\\t,./\\p{Pd}\\x{2212}]"
#: Texts without any of these have nothing to find: at least 7 digits in reach of each other, the start of an account number, an @ or
#: its disguise, digits spelled out, look-alikes. Dashes and blanks that texts are full of count as what they look like.
_CLUE = (
    rf"(?:\d[^\n\d]{{0,6}}){{6}}\d|\d\.\d{{1,3}}\.\d{{1,3}}\.\d|[A-Z]{{2}}\d{{2}}{_S}?[A-Z0-9]{{4}}|@|(?i:[\[({{<]{_S}*(?:at|ät|arroba|arobase){_S}*[\])}}>])|&#0*64;|%40"
    rf"|(?i:(?:(?:{_SPELLED_ALT}|\d){_GAPS}{{1,3}}){{5}})"
)
#: A bare "at" makes an address only with a dot in disguise.
_CLUE_AT = rf"(?i){_S}(?:at|arroba|arobase|klammeraffe){_S}"
_CLUE_DOT = rf"(?i)[\[({{<]{_S}*(?:dot|\.|punkt|punto|point){_S}*[\])}}>]|{_S}(?:dot|punkt|punto|point){_S}|&#0*46;|%2e"
_CLUE_STRANGE = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in [*_LOOKALIKES, *_INVISIBLE] if ord(c) not in (0xA0, 0x2013, 0x2014)) + "]"


class Traced:
    """A text with the source span of each character."""

    def __init__(self, text: str):
        self.text = text
        self.start = np.arange(len(text), dtype=np.int32)
        self.end = self.start + 1

    def rewritten(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces [a, b) by new characters; each stands for the whole replaced span, or its own character where lengths agree."""
        if not edits:
            return
        parts, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            parts += [self.text[at:a], new]
            starts.append(self.start[at:a])
            ends.append(self.end[at:a])
            if len(new) == b - a:
                starts.append(self.start[a:b])
                ends.append(self.end[a:b])
            else:
                starts.append(np.full(len(new), self.start[a], np.int32))
                ends.append(np.full(len(new), self.end[b - 1], np.int32))
            at = b
        self.text = "".join([*parts, self.text[at:]])
        self.start = np.concatenate([*starts, self.start[at:]])
        self.end = np.concatenate([*ends, self.end[at:]])


def _look_alikes(t: Traced) -> None:
    if not t.text.isascii():
        t.rewritten([(m.start(), m.end(), _LOOKALIKES.get(m[0], "")) for m in _STRANGE.finditer(t.text)])


def _spelled_digits(t: Traced) -> list[tuple[int, int]]:
    """Rewrites them; returns the source spans of the runs."""
    edits, spoken = [], []
    for m in _SPELLED.finditer(t.text):
        found = [(x.start() + m.start(), x.end() + m.start(), x[0].lower()) for x in _ONE.finditer(m[0])]
        if sum(w in _DIGITS for _, _, w in found) < 3 or len({_DIGITS.get(w, w) for _, _, w in found}) < 3:
            continue
        spoken.append((int(t.start[m.start()]), int(t.end[m.end() - 1])))
        edge = m.start()
        for a, b, w in found:
            if a > edge:
                edits.append((edge, a, ""))
            edits.append((a, b, _DIGITS.get(w, w)))
            edge = b
    t.rewritten(edits)
    return spoken


def _disguised_addresses(t: Traced) -> None:
    """Every at, in disguise or not, with the names before it, read backwards, and those after it; neither has a greatest length."""
    text, edits, done = t.text, [], 0
    back = text[::-1] if _AT_IN.search(text) else ""
    for at in _AT_IN.finditer(text):
        a, b = at.span()
        if a <= done:
            continue
        after = _DOMAIN.match(text, b)
        before = after and _LOCAL_BACKWARDS.match(back, len(text) - a, len(text) - done)
        if not before:
            continue
        end = after.end()
        names = [x.span() for x in _DOT_IN.finditer(text, b, end)]
        bracketed = not _PLAIN_AT.search(at[0])
        spoken = any(len(text[x:y].strip()) > 1 for x, y in names)
        if not (bracketed or spoken and text[names[-1][1] : end].lower() in _DOMAINS):
            continue
        first = len(text) - before.end()
        if any(c.isspace() for c in text[first:a]):  # only a dotted name is taken as the local part
            joints = [x for x in _DOT_IN.finditer(text, first, a) if len(x[0].strip()) > 1 or x[0] == "."]
            if not joints:
                first = max(first, 1 + max(text.rfind(c, first, a) for c in " \t\n"))
        edits += [(x.start(), x.end(), ".") for x in _DOT_IN.finditer(text, first, a) if x[0] != "."]
        if at[0] != "@":
            edits.append((a, b, "@"))
        edits += [(x, y, ".") for x, y in names if text[x:y] != "."]
        done = end
    t.rewritten(edits)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _iban(value: str) -> bool:
    s = value.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def findings(text: str) -> list[tuple[str, str, int, int, bool]]:
    """(kind, value, start, end, disguised) of a text, by place."""
    t = Traced(text)
    _look_alikes(t)
    spoken = _spelled_digits(t)
    _disguised_addresses(t)
    out = []
    for m in _BARE.finditer(t.text) if spoken else ():
        a, b = int(t.start[m.start()]), int(t.end[m.end() - 1])
        if any(x <= a and b <= y for x, y in spoken):
            out.append((_RANK["phone"], a, b, "phone", m[0], True))
    rest = t.text
    for kind, pattern in _DETECT:
        taken_by = []
        for m in pattern.finditer(rest):
            value, name = m[0], kind
            if kind == "iban" and not _iban(value):
                continue
            if kind == "card":
                digits = re.sub(r"\D", "", value)
                name = "card" if luhn(digits) else "number"
            if kind == "phone" and not 7 <= len(re.sub(r"\D", "", value)) <= 15:
                continue
            a, b = int(t.start[m.start()]), int(t.end[m.end() - 1])
            out.append((_RANK[name], a, b, name, value, text[a:b] != value))
            taken_by.append(m.span())
        parts, at = [], 0
        for a, b in taken_by:  # a later kind never runs into what is found already
            parts += [rest[at:a], "\0" * (b - a)]
            at = b
        rest = "".join([*parts, rest[at:]])
    out.sort()
    spans = Spans()
    taken = [f for f in out if spans.take(f[1], f[2])]
    return [(n, v, a, b, d) for _, a, b, n, v, d in sorted(taken, key=lambda f: f[1:3])]


def suspects(texts: pa.Array) -> np.ndarray:
    """Rows whose text has a clue: all that have findings, and some more."""
    clue = pc.or_(pc.match_substring_regex(texts, _CLUE), pc.match_substring_regex(texts, _CLUE_STRANGE))
    spoken = pc.and_(pc.match_substring_regex(texts, _CLUE_AT), pc.match_substring_regex(texts, _CLUE_DOT))
    return np.flatnonzero(pc.or_(clue, spoken).to_numpy(zero_copy_only=False))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = as_texts(b["text"])
        rows = [(b["doc_id"][int(i)].as_py(), *f) for i in suspects(texts) for f in findings(texts[int(i)].as_py())]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_()]
        cols = zip(*rows) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [c.split()[0] for c in SCHEMA.split(", ")])


def identifiers(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, value, start, end, disguised) of all documents. One pass, no shuffle."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.where("text IS NOT NULL").mapInArrow(_scan, SCHEMA)


def op6_pii(spark, sf_dir):
    return identifiers(read_table(spark, sf_dir, "documents"))


QUERIES = {"op6_pii": op6_pii}
ORACLES: dict[str, str] = {}
