"""Blocks that hold more than one license."""

import pytest

from corpusloom.llm import licenses

T = licenses.TEMPLATES


def names(text):
    return [f[2] for f in licenses.findings(text)]


def test_two_notices_of_a_block():
    text = "Released under the MIT License. Licensed under the Apache License, Version 2.0."
    assert names(text) == ["MIT", "Apache-2.0"]
    (a, b), (c, d) = [f[:2] for f in licenses.findings(text)]
    assert "MIT" in text[a:b] and "Apache" in text[c:d] and b <= c


@pytest.mark.parametrize("parts", [(("MIT", "text"), ("Apache-2.0", "header")), (("MIT", "line"), ("ISC", "line"), ("MPL-2.0", "line")), (("Apache-2.0", "header"), ("MIT", "line"), ("Zlib", "text"))])
def test_notices_pasted_together(parts):
    assert sorted(names("\n\n".join(T[n][f] for n, f in parts))) == sorted(n for n, _ in parts)
