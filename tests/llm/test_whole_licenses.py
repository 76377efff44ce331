"""Whole license texts, numbered clauses, and the scan against the texts it was made from."""

import random

import pytest

from corpusloom.llm import licenses

FULL = licenses.full_texts()


@pytest.mark.parametrize("name", sorted(FULL))
def test_whole_texts_are_one_row(name):
    text = f"Some words of mine come first.\n\n{FULL[name]}\n\nOthers follow."
    found = licenses.findings(text)
    assert [f[2] for f in found] == [name] and found[0][5] == 1.0
    a, b = found[0][:2]
    assert b - a > 0.95 * len(FULL[name].strip()) and len(found[0][6]) <= 4 and not found[0][7]


def test_whole_texts_pasted_together():
    text = "\n\n\n".join([FULL["Apache-2.0"], licenses.TEMPLATES["MIT"]["full"], FULL["GPL-2.0"]])
    assert [f[2] for f in licenses.findings(text)] == ["Apache-2.0", "MIT", "GPL-2.0"]


def test_changed_whole_text_lists_the_change():
    text = FULL["MPL-2.0"].replace("Larger Work", "Bigger Thing")
    found = licenses.findings(text)
    assert [f[2] for f in found] == ["MPL-2.0"] and {"bigger", "thing"} <= set(found[0][6]) and "larger" in found[0][7]


def test_numbers_of_a_list_tell_nothing():
    text = licenses.TEMPLATES["BSD-3-Clause"]["text"]
    for k, w in enumerate(("Redistributions of", "Redistributions in", "Neither"), 1):
        text = text.replace(w, f"{k}. {w}")
    assert [f[2] for f in licenses.findings(text)] == ["BSD-3-Clause"]
    assert licenses._telling(licenses.word_list("the GNU GPL, version 2 and CC BY 4.0: 1. first 2. second"), 0, 99) == {"gpl", "2", "4", "0"}


def test_ties_rank_by_name():
    a = [r[:2] for r in licenses.ranked(licenses.word_list("entirely other wording about cooking rice"))]
    assert a == sorted(a, key=lambda r: (-r[0], r[1]))


def test_planted_licenses_and_nothing_else(spark):
    """Every template among invented words, once or twice a document: the rows are what was planted, with their spans."""
    rng = random.Random(1)
    forms = [(n, f) for n, fs in licenses.TEMPLATES.items() for f in fs]
    word = lambda: "".join(rng.choice("bcdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5)))
    filler = lambda: " ".join(word() for _ in range(12)).capitalize() + "."
    rows, want = [(-1, None), (-2, ""), (None, filler())], set()
    for i, (name, form) in enumerate(forms * 2):
        text = filler() + "\n\n"
        for n, f in [(name, form), rng.choice(forms)][: 1 + i % 2]:
            at, body = len(text), licenses.TEMPLATES[n][f]
            text += body + "\n\n" + filler() + "\n\n" + filler() + "\n\n"
            want.add((i, n, at, at + len(body)))
        rows.append((i, text))
    got = licenses.licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.license, r.start, r.end) for r in got} == want and len(got) == len(want)
