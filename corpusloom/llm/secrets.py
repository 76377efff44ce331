"""Secret scan with a recursive decoding worklist.

A text is layer 0. Encoded stretches of a layer (URL escapes, Unicode and HTML escapes, base64 in both
alphabets, hexadecimal, and gzip, zlib, bzip2, xz or zstandard data inside those) are unwrapped to new layers until
nothing new comes up; a layer already seen at its place isn't unwrapped again, so cycles end. Every layer is
scanned, and each finding's span is mapped back through the layers to the characters of the text: exactly
through escapes, to the encoded stretch through base64, hexadecimal and compression.

Defined results: null and empty texts have no findings. A null doc_id is reported as null. Repeated rows are
reported each. Of overlapping findings of one layer the longest is reported, then the first; a secret found again at the same
place through another layer is reported once, from the outermost. Data that decompresses to more than
``max_bytes`` is reported as kind ``oversized``, with its span, and scanned as far as those bytes go; so is data whose
decompressor would need more memory than that, without a scan. All members of a compressed
stream are read; one that breaks off is scanned as far as it goes, under a layer name that ends in ``-truncated``.
Values have no greatest length.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import html
import lzma
import math
import re
import zlib
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import read_table
from corpusloom.llm.words import Spans, as_texts

SCHEMA = "doc_id bigint, kind string, secret string, start int, end int, layers string"
#: Greatest size of one decompressed layer.
MAX_BYTES = 1 << 26

_RULES = [
    ("private_key", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----[\s\S]*?(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----|\Z)"),
    ("aws_access_key", r"(?<![A-Z0-9])(?:AKIA|ASIA|AGPA|AIDA|AROA)[A-Z0-9]{16}(?![A-Z0-9])"),
    ("github_token", r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{50,})"),
    ("slack_token", r"(?<![A-Za-z0-9])xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    ("google_api_key", r"(?<![A-Za-z0-9_-])AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])"),
    ("stripe_key", r"(?<![A-Za-z0-9])[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    ("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{10,}"),
    ("url_password", r"(?<![A-Za-z0-9])[a-z][a-z0-9+.-]{1,20}://[^\s/:@\"']+:[^\s/:@\"']{3,}@[A-Za-z0-9.-]+"),
    ("assigned", r"(?i:(?:(?<![A-Za-z])|(?-i:(?<=[a-z])(?=[A-Z])))(?:[A-Za-z]{1,20}[_-]){0,3}(?:api[_-]?key|apikey|token|secret|passw(?:or)?d|passwd|pwd|access[_-]?key|auth[_-]?key|credential)s?(?:[_-][A-Za-z]{1,20}){0,2})[\"']?\s{0,3}(?::=|=>|[:=])\s{0,3}[\"'`]?(?P<value>[A-Za-z0-9+/_.~!@#$%^&*=-]{8,})"),
]
_RULES = [(k, re.compile(p)) for k, p in _RULES]
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(
    r"\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}(?:\\u[dD][c-fC-F][0-9A-Fa-f]{2})?|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[xX][0-9A-Fa-f]{1,6};|&#\d{1,7};|&(?:quot|amp|lt|gt|apos|equals|colon|sol|plus|lowbar|hyphen);"
)
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/]{16,}|[A-Za-z0-9_-]{16,})={0,2}(?![A-Za-z0-9+/_=])")
#: Base64 in lines; its lines are also tried one by one, as they may be separate.
_WRAPPED = re.compile(
    r"(?<![A-Za-z0-9+/_-])(?:(?:[A-Za-z0-9+/]{40,}[ \t]*\r?\n[ \t]*)+[A-Za-z0-9+/]+|(?:[A-Za-z0-9_-]{40,}[ \t]*\r?\n[ \t]*)+[A-Za-z0-9_-]+)={0,2}(?![A-Za-z0-9+/_=-])"
)
_HEX = re.compile(r"(?<![A-Za-z0-9])(?:[0-9A-Fa-f]{2}){8,}(?![A-Za-z0-9])")
#: A text without any of these has neither a secret nor anything to decode; long runs must hold a digit or both cases.
_CLUE = (
    r"%[0-9A-Fa-f]{2}|\\[uUx][0-9A-Fa-f{]|&#|&(?:quot|amp|lt|gt|apos|equals|colon|sol|plus|lowbar|hyphen);|PRIVATE KEY-----|://[^\s/@]*@"
    r"|[A-Za-z0-9+/_-]{16,}|(?i:(?:key|token|secret|passw|pwd|credential)[A-Za-z_-]{0,50}[^A-Za-z0-9_]{0,5}[:=])"
)


def _value_ok(value: str) -> bool:
    """A literal worth reporting: not a plain word or a placeholder."""
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    if kinds < 2 or len(set(value)) < 5:
        return False
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= 2.5


def scan(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, secret, start, end) of one layer, without overlaps."""
    found = []
    for rank, (kind, rule) in enumerate(_RULES):
        for m in rule.finditer(text):
            a, b = m.span("value") if kind == "assigned" else m.span()
            if kind == "assigned":
                while b > a and text[b - 1] in ".!,;":
                    b -= 1
                if not _value_ok(text[a:b]):
                    continue
            found.append((a - b, a, rank, kind, text[a:b], b))
    spans = Spans()
    out = [(kind, secret, a, b) for _, a, _, kind, secret, b in sorted(found) if spans.take(a, b)]
    return sorted(out, key=lambda f: f[2])


def _printable(data: bytes, cut: bool = False) -> str | None:
    """The text that the bytes are, if they are one; of data that was cut off the last character may be missing."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError as e:
        if cut and e.start >= len(data) - 3:
            return _printable(data[: e.start])
        if len(data) >= 4 and data[:2] in (b"\xff\xfe", b"\xfe\xff"):
            try:
                text = data.decode("utf-16")
            except UnicodeDecodeError:
                return None
        else:
            return None
    bad = sum(not (c.isprintable() or c in "\t\n\r") for c in text)
    return text if text and bad * 20 <= len(text) else None


class Oversized(Exception):
    """Decompressing would take more than it may; ``args[0]`` is what was decompressed until then."""


class _Zstd:
    """One frame of zstandard data, with the interface of the other decompressors."""

    eof, unused_data = False, b""

    def decompress(self, data: bytes, most: int) -> bytes:
        import zstandard

        try:
            if zstandard.get_frame_parameters(data).window_size > _WINDOW:
                raise Oversized(b"")
            with zstandard.ZstdDecompressor(max_window_size=_WINDOW).stream_reader(data) as r:
                if len(out := r.read(most)) == most:
                    return out
            one = zstandard.ZstdDecompressor(max_window_size=_WINDOW).decompressobj()
            one.decompress(data)  # its size is known to be bounded
        except zstandard.ZstdError as e:
            raise ValueError from e
        self.eof, self.unused_data = one.eof, one.unused_data
        return out


class _Xz:
    """One xz stream."""

    def __init__(self):
        self.one = lzma.LZMADecompressor(lzma.FORMAT_XZ, memlimit=2 * _WINDOW)

    def decompress(self, data: bytes, most: int) -> bytes:
        try:
            out = self.one.decompress(data, most)
        except lzma.LZMAError as e:
            if "emory" in str(e):
                raise Oversized(b"") from e
            raise
        self.eof, self.unused_data = self.one.eof, self.one.unused_data
        return out


_WINDOW = 1 << 27
_FORMATS = (
    ("gzip", b"\x1f\x8b", lambda: zlib.decompressobj(31)),
    ("zlib", b"\x78", lambda: zlib.decompressobj(15)),
    ("bzip2", b"BZh", bz2.BZ2Decompressor),
    ("xz", b"\xfd7zXZ\x00", _Xz),
    ("zstd", b"\x28\xb5\x2f\xfd", _Zstd),
)


def _inflate(data: bytes, max_bytes: int) -> tuple[str, bytes] | None:
    """The name of the format and the content of all members of compressed data, or None; a stream that breaks off says so in its name."""
    for name, magic, make in _FORMATS:
        if data.startswith(magic) and (name != "zlib" or len(data) > 6 and (data[0] << 8 | data[1]) % 31 == 0):
            break
    else:
        return None
    parts, left, rest, whole = [], max_bytes + 1, data, True
    while whole and rest.startswith(magic):
        d = make()
        try:
            parts.append(d.decompress(rest, left))
        except Oversized as e:
            raise Oversized(b"".join(parts), name) from e
        except (ValueError, OSError, EOFError, zlib.error, lzma.LZMAError):
            if not parts:
                return None
            whole = False
            break
        left -= len(parts[-1])
        if left <= 0:
            raise Oversized(b"".join(parts)[:max_bytes], name)
        whole = d.eof
        rest = d.unused_data.lstrip(b"\0")  # members may be padded
    return name if whole else f"{name}-truncated", b"".join(parts)


def _base64(run: str) -> bytes | None:
    s = re.sub(r"\s", "", run).rstrip("=")
    if len(s) % 4 == 1:
        return None
    s = s.replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


class Layer:
    """A decoded text and where each of its characters came from: a span of the outermost text."""

    def __init__(self, text: str, names: tuple[str, ...], span: tuple[int, int] | None = None, pieces: list | None = None):
        self.text, self.names, self.span, self.pieces = text, names, span, pieces
        self.ends = [p[1] for p in pieces] if pieces else []

    def source(self, a: int, b: int) -> tuple[int, int]:
        if self.span:
            return self.span
        if self.pieces is None:
            return a, b
        from bisect import bisect_right

        def of(i: int) -> tuple[int, int]:
            lo, _, x, y, same = self.pieces[bisect_right(self.ends, i)]
            return (x + i - lo, x + i - lo + 1) if same else (x, y)

        return of(a)[0], of(b - 1)[1]


def _substituted(layer: Layer, name: str, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every match decoded in place, if any is."""
    parts, pieces, at, n, changed = [], [], 0, 0, False

    def keep(a: int, b: int) -> None:
        nonlocal n
        if a == b:
            return
        parts.append(layer.text[a:b])
        if layer.pieces is None:  # runs of unchanged characters map one to one
            pieces.append((n, n + b - a, a, b, True))
            n += b - a
        else:
            for i in range(a, b):
                pieces.append((n, n + 1, *layer.source(i, i + 1), False))
                n += 1

    for m in pattern.finditer(layer.text):
        new = decode(m[0])
        if new is None or new == m[0] or not new:
            continue
        keep(at, m.start())
        x, y = layer.source(m.start(), m.end())
        parts.append(new)
        pieces.append((n, n + len(new), x, y, False))
        n, at, changed = n + len(new), m.end(), True
    if not changed:
        return None
    keep(at, len(layer.text))
    return Layer("".join(parts), (*layer.names, name), layer.span, None if layer.span else pieces)


def _unurl(run: str) -> str | None:
    try:
        return bytes.fromhex(run.replace("%", "")).decode("utf-8")
    except UnicodeDecodeError:
        return None


def _unescape(run: str) -> str | None:
    if run[0] == "&":
        return html.unescape(run)
    try:
        if run.startswith("\\u{"):
            return chr(int(run[3:-1], 16))
        if len(run) == 12:
            return run.encode().decode("unicode_escape").encode("utf-16", "surrogatepass").decode("utf-16")
        c = chr(int(run[2:], 16))
        return None if 0xD800 <= ord(c) < 0xE000 else c
    except (ValueError, OverflowError, UnicodeError):
        return None


def _unwrapped(layer: Layer, max_bytes: int) -> Iterator[Layer]:
    for name, pattern, decode in (("url", _URL, _unurl), ("unicode", _ESCAPE, _unescape)):
        if (new := _substituted(layer, name, pattern, decode)) is not None:
            yield new
    for name, pattern in (("hex", _HEX), ("base64", _BASE64), ("base64", _WRAPPED)):
        for m in pattern.finditer(layer.text):
            run = m[0]
            if name == "base64" and (run.islower() or run.isupper() or run.isdigit()) and not re.search("[0-9+/=_-]", run):
                continue
            data = bytes.fromhex(run) if name == "hex" else _base64(run)
            if not data:
                continue
            span, names = layer.source(*m.span()), (*layer.names, name)
            try:
                unwrapped = {data}
                while (inner := _inflate(data, max_bytes)) is not None and inner[1] not in unwrapped:
                    names, data = (*names, inner[0]), inner[1]
                    unwrapped.add(data)
            except Oversized as e:
                yield Layer("", (*names, "oversized"), span)
                data, names = e.args[0], (*names, f"{e.args[1]}-truncated")
            text = _printable(data, "truncated" in names[-1])
            if text is not None:
                yield Layer(text, names, span)


def findings(text: str, max_bytes: int = MAX_BYTES) -> list[tuple[str, str, int, int, str]]:
    """(kind, secret, start, end, layers) of a text; layers are the names of the encodings around it."""
    work, seen, out = deque([Layer(text, ())]), {(text, None)}, {}
    places: dict[tuple[str, str], Spans] = {}
    while work:
        layer = work.popleft()
        if layer.names and layer.names[-1] == "oversized":
            out.setdefault(("oversized", "", *layer.span), "/".join(layer.names[:-1]))
            continue
        for kind, secret, a, b in scan(layer.text):
            span = layer.source(a, b)
            if places.setdefault((kind, secret), Spans()).take(*span):
                out[kind, secret, *span] = "/".join(layer.names)
        for new in _unwrapped(layer, max_bytes):
            key = (new.text, new.span)
            if key not in seen:
                seen.add(key)
                work.append(new)
    found = sorted(((*k, v) for k, v in out.items()), key=lambda f: (f[2], f[3], f[0], f[1]))
    # the lines of wrapped data give parts of what the whole of it holds
    long = [f for f in found if "base64" in f[4] and "\n" in text[f[2] : f[3]]]
    return [f for f in found if not any(f is not g and f[1] != g[1] and f[1] in g[1] and g[2] <= f[2] and f[3] <= g[3] and (f[2], f[3]) != (g[2], g[3]) for g in long)]


def _scan(max_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_texts(b["text"])
            hits = pc.indices_nonzero(pc.match_substring_regex(texts, _CLUE)).to_pylist()
            rows = [(b["doc_id"][i].as_py(), *f) for i in hits for f in findings(texts[i].as_py(), max_bytes)]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            cols = zip(*rows) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [c.split()[0] for c in SCHEMA.split(", ")])

    return run


def secrets(docs: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(doc_id, kind, secret, start, end, layers) of all documents. One pass, no shuffle."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.where("text IS NOT NULL").mapInArrow(_scan(max_bytes), SCHEMA)


def op1_secret_scan(spark, sf_dir):
    return secrets(read_table(spark, sf_dir, "documents"))


QUERIES = {"op1_secret_scan": op1_secret_scan}
ORACLES: dict[str, str] = {}
