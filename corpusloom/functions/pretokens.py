"""Pretokens of many texts at once: those of :func:`text.raw_pretokens`, found in their bytes, without a regular expression's list of matches for each text."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as tx

OTHER, WORD, DIGIT, SPACE = range(4)
#: Bytes that are looked at together.
SEGMENT = 1 << 19
_KINDS: dict[str, bytes] = {}


def kinds(spark: SparkSession) -> bytes:
    """The kind of every code point, as the executors' regular expressions have it (compressed); asked once an application."""
    app = spark.sparkContext.applicationId
    if app not in _KINDS:
        char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        rows = spark.range(0x110000).where("id NOT BETWEEN 55296 AND 57343").select("id", tx.char_kind(char).alias("kind")).where("kind <> 'punct'").toArrow()
        out, name = np.full(0x110000, OTHER, np.uint8), rows["kind"].to_numpy()
        for k, what in enumerate(("word", "digit", "space"), WORD):
            out[rows["id"].to_numpy()[name == what]] = k
        _KINDS[app] = zlib.compress(out.tobytes())
    return _KINDS[app]


def whole(text: Column) -> Column:
    """A text whose bytes are UTF-8."""
    return F.make_valid_utf8(text.cast("string"))


class Pretokenizer:
    def __init__(self, kinds: bytes):
        self.kind = np.frombuffer(zlib.decompress(kinds), np.uint8)
        self.byte = np.full(256, OTHER, np.uint8)
        self.byte[:128] = self.kind[:128]

    def _kinds(self, buf: np.ndarray) -> np.ndarray:
        """The kind of the character that each byte belongs to."""
        kind = self.byte[buf]
        lead = np.flatnonzero(buf >= 0xC0)
        if len(lead):
            first = buf[lead].astype(np.int32)
            size = 2 + (first >= 0xE0) + (first >= 0xF0)
            code = first & np.where(size == 2, 0x1F, np.where(size == 3, 0x0F, 0x07))
            for j in range(1, 4):
                more = size > j
                code[more] = code[more] << 6 | buf[lead[more] + j] & 0x3F
            what = self.kind[code]
            kind[lead] = what
            for j in range(1, 4):
                more = size > j
                kind[lead[more] + j] = what[more]
        return kind

    def _segment(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all pretokens, where each starts, and how many each text has."""
        n = len(buf)
        kind = self._kinds(buf)
        begins = off[:-1][off[:-1] < off[1:]]
        start = np.empty(n, bool)
        start[0] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start[begins] = True
        start |= (kind == OTHER) & ((buf & 0xC0) != 0x80)  # each by itself
        space = kind == SPACE
        start &= ~space
        at = np.flatnonzero(start)
        number = np.diff(np.searchsorted(at, off))
        if not len(at):
            return buf[:0], at, number
        blank = np.zeros(len(at), bool)
        blank[1:] = space[at[1:] - 1]
        blank[0] = at[0] > 0 and space[at[0] - 1]
        first = np.searchsorted(at, begins)
        blank[first[first < len(at)]] &= ~np.isin(at[first[first < len(at)]], begins)
        # the last byte of white space before a pretoken is its blank; the rest of it goes
        before = at[blank] - 1
        space[before] = False
        gone = np.flatnonzero(space)
        at = at - blank
        if len(gone):
            at = at - np.searchsorted(gone, at)
        if (buf[before] != 32).any():
            buf = buf.copy()
            buf[before] = 32
        return buf[~space] if len(gone) else buf, at, number

    def __call__(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The raw pretokens, one text's after the other's, and how many each text has; a null has none."""
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        texts = texts.cast(pa.large_string())
        n = len(texts)
        off = np.frombuffer(texts.buffers()[1], np.int64, n + 1, 8 * texts.offset) if n else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
        off = off - off[0]
        parts, starts, numbers, size, i = [], [], [], 0, 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + SEGMENT, "right")) - 1)
            if off[j] > off[i]:
                buf, at, number = self._segment(data[off[i] : off[j]], off[i : j + 1] - off[i])
                parts.append(buf)
                starts.append(at + size)
                size += len(buf)
            else:
                number = np.zeros(j - i, np.int64)
            numbers.append(number)
            i = j
        at = np.concatenate([*starts, [size]]).astype(np.int64)
        buf = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        if size < 1 << 31:
            words = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(buf))
        else:
            words = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(buf))
        return words, np.concatenate([np.zeros(0, np.int64), *numbers])


def marked(words: pa.Array) -> pa.Array:
    """Raw pretokens with their mark: no pretoken has a blank elsewhere."""
    return pc.replace_substring(words, " ", tx.MARK)
