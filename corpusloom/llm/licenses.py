"""License scan by conditional compression.

Segments of a text that are worded like licenses form blocks. A block is compressed alone and with every
template as zstandard raw dictionary; the relative size reductions rank the templates. In that order a
template is confirmed by the exact wording: the differing words are listed, enough of the template or of the
block must agree, and the words that tell licenses apart (versions, nc, nd, sa, lesser, affero, ...) must be
the same. A confirmed template's wording is cut out, and what is left of the block is ranked again, so that each
license of a block is a row, with a span of its own where there are several. A block that no template is confirmed for is reported as ``unknown`` with its nearest template.

Whole license texts, of thousands of words, are looked for first: a stretch that shares many runs of ``GRAM`` words with them is a block by itself, ranked
and confirmed in the same way, and what it takes up is one row, however many sections it has.

Defined results: null and empty texts have no blocks. A null doc_id is reported as null. Repeated rows are
reported each. Equal reductions rank by the template's name. Spans are [start, end) in characters.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from functools import lru_cache
from importlib.resources import files

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import read_table
from corpusloom.llm.words import WORD, as_texts, grams, words

SCHEMA = "doc_id bigint, start int, end int, license string, template string, reduction double, agreement double, added array<string>, missing array<string>"
_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string())]

_LIABLE = "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_LIABLE = "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC_LIABLE = "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_ZLIB_REST = "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'


def _gnu(name: str, versions: tuple[str, ...]) -> dict[str, str]:
    out = {}
    for v in versions:
        out[f"header-{v}"] = f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
        out[f"line-{v}"] = f"This work is licensed under the {name}, version {v}."
    return out


def _templates() -> dict[str, dict[str, str]]:
    t: dict[str, dict[str, str]] = {
        "MIT": {
            "text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS,
            "line": "Released under the MIT License.",
        },
        "ISC": {
            "text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
            "line": "Released under the ISC License.",
        },
        "BSD-2-Clause": {"text": f"{_BSD_HEAD} {_BSD_TAIL}", "line": "Licensed under the BSD 2-Clause License."},
        "BSD-3-Clause": {
            "text": f"{_BSD_HEAD} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_TAIL}",
            "line": "Licensed under the BSD 3-Clause License.",
        },
        "Apache-2.0": {
            "header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
            "line": "Licensed under the Apache License, Version 2.0.",
        },
        "MPL-2.0": {
            "header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
            "line": "Licensed under the Mozilla Public License, Version 2.0.",
        },
        "Unlicense": {
            "text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
            "line": "Released into the public domain under the Unlicense.",
        },
        "Zlib": {
            "text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.",
            "line": "Released under the zlib License.",
        },
        "BSL-1.0": {
            "text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software.",
            "line": "Distributed under the Boost Software License, Version 1.0.",
        },
        "CC0-1.0": {"line": "Released under CC0 1.0 Universal.", "named": "Dedicated to the public domain under the Creative Commons CC0 1.0 Universal Public Domain Dedication."},
    }
    t |= {
        f"GPL-{v}.0": {k: x for k, x in _gnu("GNU General Public License", (v,)).items()} for v in ("2", "3")
    } | {f"LGPL-{v}": _gnu("GNU Lesser General Public License", (v.removesuffix(".0"),)) for v in ("2.1", "3.0")} | {"AGPL-3.0": _gnu("GNU Affero General Public License", ("3",))}
    named = {"": "", "-NC": "-NonCommercial", "-SA": "-ShareAlike", "-ND": "-NoDerivatives", "-NC-SA": "-NonCommercial-ShareAlike", "-NC-ND": "-NonCommercial-NoDerivatives"}
    for short, long in named.items():
        for v in ("3.0", "4.0"):
            t[f"CC-BY{short}-{v}"] = {
                "line": f"Licensed under CC BY{short} {v}.",
                "named": f"This work is licensed under a Creative Commons Attribution{long} {v} {'International' if v == '4.0' else 'Unported'} License.",
            }
    for name, rest in (("MIT", _LIABLE), ("ISC", _ISC_LIABLE), ("BSD-2-Clause", _BSD_LIABLE), ("BSD-3-Clause", _BSD_LIABLE), ("Zlib", _ZLIB_REST)):
        t[name]["full"] = f"{t[name]['text']} {rest}"
    for name, forms in t.items():
        forms["spdx"] = f"SPDX-License-Identifier: {name}"
    return t


TEMPLATES = _templates()
#: Whole texts of licenses by their files' names.
FULL = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0"}
#: Words of the runs by which whole texts are found, how many of them must be there, and words between two that part stretches.
GRAM, RUNS, APART = 6, 30, 200
#: Words that tell one license from another: they must be the same in a block and its template.
_TELLING = frozenset("nc nd sa noncommercial noderivatives noderivs sharealike lesser affero cc0 zero mit isc bsd apache mozilla mpl boost zlib unlicense gpl lgpl agpl".split())
_CLUE = r"(?i)licen[cs]|copyright|spdx|creative commons|\bcc[ -]by|\bcc0|warrant|\b[al]?gpl|redistribut|public domain|rights reserved|permission"
_CLUE_PY = re.compile(_CLUE)
_SEGMENT = re.compile(r"[^\n]*?(?:[.!?:;](?=\s+[A-Z(©\"])|(?=\n)|\Z)", re.S)


_START = re.compile(r"[.!?;][\s\"')]|\n\s*\n")
_PART = re.compile(r"\d+|[^\W\d_]+")
_SAME = {"licence": "license", "licences": "licenses", "licenced": "licensed", "v": "version", "ver": "version"}


def word_list(text: str) -> list[str]:
    """Words and numbers apart, in one spelling."""
    return [_SAME.get(w, w) for w in _PART.findall(text.lower())]


@lru_cache(1)
def _prepared():
    import zstandard

    out = []
    for name, forms in sorted(TEMPLATES.items()):
        for form, text in sorted(forms.items()):
            ws = word_list(text)
            d = zstandard.ZstdCompressionDict(" ".join(ws).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            level = zstandard.ZstdCompressionParameters.from_level(19, source_size=4096, dict_size=4096, write_content_size=0, min_match=3)
            out.append((name, f"{name}/{form}", ws, zstandard.ZstdCompressor(dict_data=d, compression_params=level)))
    alone = zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters.from_level(19, source_size=4096, write_content_size=0, min_match=3))
    vocabulary = frozenset(w for _, _, ws, _ in out for w in ws) | {"c", "copyright", "all", "rights", "reserved", "licence", "licenced"}
    return out, alone, vocabulary


def full_texts() -> dict[str, str]:
    folder = files("corpusloom.llm") / "license_texts"
    return {name: (folder / f"{f}.txt").read_text("utf-8") for name, f in FULL.items()}


@lru_cache(1)
def _full():
    """(license, words, compressor, compressed size) of the whole texts; a compressor without dictionary; the hashes of their runs in order."""
    import zstandard

    level = zstandard.ZstdCompressionParameters.from_level(12, source_size=1 << 17, dict_size=1 << 16, write_content_size=0, min_match=3)
    alone = zstandard.ZstdCompressor(compression_params=level)
    out, runs = [], []
    for name, text in sorted(full_texts().items()):
        ws = word_list(text)
        data = " ".join(ws).encode()
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        out.append((name, ws, zstandard.ZstdCompressor(dict_data=d, compression_params=level), len(alone.compress(data))))
        runs.append(grams(words(pa.array([text])), GRAM)[0])
    return out, alone, np.unique(np.concatenate(runs))


def stretches(text: str) -> list[tuple[int, int]]:
    """Spans that share many runs of words with whole license texts."""
    runs = _full()[2]
    g, _ = grams(words(pa.array([text])), GRAM)
    at = np.flatnonzero(runs[np.minimum(np.searchsorted(runs, g), len(runs) - 1)] == g)
    if len(at) < RUNS:
        return []
    spans = [m.span() for m in WORD.finditer(text.lower())]
    if len(spans) < len(g) + GRAM - 1 or len(text.lower()) != len(text):
        return []
    parts = np.split(at, np.flatnonzero(np.diff(at) > APART) + 1)
    # a header or a title may stand before the first run
    return [(spans[max(0, int(p[0]) - 2)][0], spans[min(len(spans), int(p[-1]) + GRAM + 2) - 1][1]) for p in parts if len(p) >= RUNS]


def _whole_licenses(text: str) -> list[tuple]:
    """Rows as of :func:`findings` for whole license texts."""
    out = []
    prepared, alone, _ = _full()
    todo = stretches(text)
    while todo:
        a, b = todo.pop()
        spans = [m.span() for m in _PART.finditer(text, a, b)]
        ws = [_SAME.get(w, w) for w in (text[x:y].lower() for x, y in spans)]
        data = " ".join(ws).encode()
        size = len(alone.compress(data))
        saved = sorted(((size - len(c.compress(data)), name, tws, own) for name, tws, c, own in prepared), key=lambda r: (-r[0], r[1]))
        starts = frozenset(k for k in range(1, len(spans)) if _START.search(text, spans[k - 1][1], spans[k][0]))
        for gain, name, tws, own in saved:
            if gain < 0.3 * own:  # too little of the license's wording is in it
                break
            ok, agreement, added, missing, taken = confirmed(ws, tws, starts)
            if not ok or agreement < 0.6:
                continue
            lo, hi = taken[0][0], taken[-1][1]
            out.append((spans[lo][0], spans[hi - 1][1], name, f"{name}/whole", round(gain / size, 4), agreement, added, missing))
            todo += [(spans[x][0], spans[y - 1][1]) for x, y in ((0, lo), (hi, len(ws))) if y - x >= RUNS]
            break
    return sorted(out, key=lambda f: f[:2])


def blocks(text: str) -> list[tuple[int, int]]:
    """Spans of successive segments most words of which occur in templates, with a clue among them."""
    vocabulary = _prepared()[2]
    out: list[list[int]] = []
    at = 0
    open_ = False
    while at < len(text):
        m = _SEGMENT.match(text, at)
        a, b = m.span()
        ws = word_list(text[a:b])
        if ws:
            fits = sum(w in vocabulary for w in ws) >= 0.6 * len(ws)
            if fits and open_:
                out[-1][1] = b
            elif fits:
                out.append([a, b])
            open_ = fits
        at = max(b, at + 1)
    trimmed = []
    for a, b in out:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if _CLUE_PY.search(text, a, b):
            trimmed.append((a, b))
    return trimmed


#: What stands before a number of a license's name; other numbers are those of a list.
_NUMBERED = frozenset("version bsd mpl gpl lgpl agpl apache by nc sa nd cc bsl zlib attribution noncommercial sharealike noderivatives noderivs mozilla".split())


def _telling(ws: list[str], at: int, count: int) -> set[str]:
    out = set()
    for k in range(at, min(at + count, len(ws))):
        w = ws[k]
        if w in _TELLING:
            out.add(w)
        elif w.isdigit() and len(w) <= 2:
            lead = k - 1 if k and ws[k - 1].isdigit() else k  # 2.0 is two numbers
            if lead and ws[lead - 1] in _NUMBERED or ws[k + 1 : k + 2] in (["clause"], ["universal"]):
                out.add(w)
    return out


def ranked(ws: list[str]) -> list[tuple[float, str, str, list[str]]]:
    """(reduction, template, license, template's words), the greatest reduction first."""
    prepared, alone, _ = _prepared()
    data = " ".join(ws).encode()
    size = len(alone.compress(data))
    out = [(round(1 - len(c.compress(data)) / size, 4), key, name, tws) for name, key, tws, c in prepared]
    return sorted(out, key=lambda r: (-r[0], r[1]))


def _runs(same: list, gap: int = 12) -> list[list]:
    """Matching blocks in runs that no more than ``gap`` other words of the text part."""
    out: list[list] = []
    for m in same:
        if m.size:
            if out and m.a - out[-1][-1].a - out[-1][-1].size <= gap:
                out[-1].append(m)
            else:
                out.append([m])
    for run in out:  # ends that are farther off than they are long belong to other wording
        while len(run) > 1 and run[-1].size <= run[-1].a - run[-2].a - run[-2].size:
            run.pop()
        while len(run) > 1 and run[0].size <= run[1].a - run[0].a - run[0].size:
            run.pop(0)
    return out


def confirmed(ws: list[str], tws: list[str], starts: frozenset[int] = frozenset()) -> tuple[bool, float, list[str], list[str], list[tuple[int, int]]]:
    """Whether the wording is the template's; the agreement; words added to and missing from the template; the spans of words it takes up.

    ``starts`` are the words that begin a sentence or paragraph: what stands before them says nothing of what follows.
    Where the whole of the words doesn't fit, as with two licenses in a row, their best run is looked at alone.
    """
    match = difflib.SequenceMatcher(None, ws, tws, False)
    same = match.get_matching_blocks()
    runs = _runs(same)
    most = max((sum(m.size for m in r) for r in runs), default=0)
    # single words of the template also stand elsewhere
    taken = [(r[0].a, r[-1].a + r[-1].size) for r in runs if sum(m.size for m in r) >= max(4, most / 4) or sum(m.size for m in r) == most]
    ops = match.get_opcodes()
    added = [w for tag, a, b, _, _ in ops if tag in ("delete", "replace") for w in ws[a:b]]
    missing = [w for tag, _, _, a, b in ops if tag in ("insert", "replace") for w in tws[a:b]]

    def fits(n: int, lo: int, hi: int, size: int, margin: int) -> tuple[bool, float]:
        of_template, of_block = n / max(1, len(tws)), n / max(1, size)
        for _ in range(margin):
            lo, hi = lo - (lo > 0 and lo not in starts), hi + (hi not in starts)
        tells = _telling(ws, lo, hi - lo)
        agree = tells == _telling(tws, 0, len(tws)) or of_template < 0.9 and tells <= _telling(tws, 0, len(tws)) and n >= 20
        ok = agree and (of_template >= 0.85 or of_block >= 0.9 and n >= 12 or of_template >= 0.6 and of_block >= 0.6 and n >= 4)
        return ok, round(max(of_template, of_block), 4)

    n = sum(m.size for m in same)
    lo = min((m.a for m in same if m.size), default=0)
    hi = max((m.a + m.size for m in same if m.size), default=0)
    ok, agreement = fits(n, lo, hi, len(ws), 2)
    if not ok and len(runs) > 1:
        best = max(runs, key=lambda r: sum(m.size for m in r))
        k, lo, hi = sum(m.size for m in best), best[0].a, best[-1].a + best[-1].size
        if k >= 0.85 * len(tws) and fits(k, lo, hi, len(ws), 2)[0]:
            ok, agreement, taken = True, fits(k, lo, hi, len(ws), 2)[1], [(lo, hi)]
            added = []
            missing = []
            for tag, a, b, c, d in difflib.SequenceMatcher(None, ws[lo:hi], tws, False).get_opcodes():
                added += ws[lo + a : lo + b] if tag in ("delete", "replace") else []
                missing += tws[c:d] if tag in ("insert", "replace") else []
    return ok, agreement, added, missing, taken


def findings(text: str) -> list[tuple]:
    """(start, end, license, template, reduction, agreement, added, missing) of each license of each block.

    What a confirmed template takes up is cut out, and the pieces left are ranked again until none is confirmed.
    """
    out = _whole_licenses(text)
    whole = [f[:2] for f in out]
    for a, b in blocks(text):
        if any(x < b and a < y for x, y in whole):
            rest = [a, *(min(max(e, a), b) for f in whole for e in f), b]
            left = [(x, y) for x, y in zip(rest[::2], rest[1::2]) if y > x and _CLUE_PY.search(text, x, y) and len(word_list(text[x:y])) >= 3]
        else:
            left = [(a, b)]
        for x, y in left:
            out += _block(text, x, y)
    return sorted(out, key=lambda f: f[:2])


def _block(text: str, a: int, b: int) -> list[tuple]:
    """The rows of one block."""
    spans = [m.span() for m in _PART.finditer(text, a, b)]
    ws = [_SAME.get(w, w) for w in (text[x:y].lower() for x, y in spans)]
    order = ranked(ws)
    if order[0][0] < 0.2:  # no template's wording is in it
        return []
    starts = {k for k in range(1, len(spans)) if _START.search(text, spans[k - 1][1], spans[k][0])}
    found: dict[str, tuple] = {}
    pieces = [(0, len(ws), order)]
    while pieces:
        lo, hi, order = pieces.pop()
        part = ws[lo:hi]
        order = ranked(part) if order is None else order
        for reduction, key, name, tws in order:
            if reduction < max(0.2, 0.3 * order[0][0]):  # what compresses so much worse isn't worded like the piece
                break
            ok, *wording, taken = confirmed(part, tws, frozenset(k - lo for k in starts))
            if not ok:
                continue
            if name not in found:
                found[name] = (spans[lo + taken[0][0]][0], spans[lo + taken[-1][1] - 1][1], name, key, reduction, *wording)
            ends = [0, *(x for t in taken for x in t), len(part)]
            for x, y in zip(ends[::2], ends[1::2]):
                if y - x >= 3 and _CLUE_PY.search(text, spans[lo + x][0], spans[lo + y - 1][1]):
                    pieces.append((lo + x, lo + y, None))
            break
    if not found:
        reduction, key, _, tws = ranked(ws)[0]
        found["unknown"] = (a, b, "unknown", key, reduction, *confirmed(ws, tws, frozenset(starts))[1:4])
    if len(found) == 1:
        found = {k: (a, b, *f[2:]) for k, f in found.items()}
    return sorted(found.values())


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = as_texts(b["text"])
        hits = pc.indices_nonzero(pc.match_substring_regex(texts, _CLUE)).to_pylist()
        rows = [(b["doc_id"][i].as_py(), *f) for i in hits for f in findings(texts[i].as_py())]
        cols = zip(*rows) if rows else [[]] * len(_KINDS)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS)], [c.split()[0] for c in SCHEMA.split(", ")])


def licenses(docs: DataFrame) -> DataFrame:
    """Rows of :data:`SCHEMA` for every license block. One pass, no shuffle."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.where("text IS NOT NULL").mapInArrow(_scan, SCHEMA)


def op2_license_scan(spark, sf_dir):
    return licenses(read_table(spark, sf_dir, "documents"))


QUERIES = {"op2_license_scan": op2_license_scan}
ORACLES: dict[str, str] = {}
