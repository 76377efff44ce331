"""Texts without a clue have no findings, and what is planted is found whole: spans, values and all."""

import base64
import bz2
import gzip
import lzma
import random
import zlib

import pyarrow as pa
import pyarrow.compute as pc
import pytest
import zstandard

from corpusloom.llm import pii, secrets

TOKEN = "ghp_" + "aB3dE6gH9jK2mN5pQ8sT1vW4yZ7bC0eF3hI6"
WORDS = "the quiet river ran past old mills and nobody asked why it did so for years".split()
GAPS = [" ", " ", "\t", "  ", " "]


def filler(rng):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 9)))


def address(rng):
    """An address as it is written, and its value."""
    names = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(rng.choice([1, 2, 3, 20]))]
    hosts = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(rng.choice([1, 2, 30]))] + [rng.choice(["com", "org"])]
    g = rng.choice(GAPS)
    at, dot = rng.choice([("@", "."), (f"{g}[at]{g}", f"{g}[dot]{g}"), (f"{g}at{g}", f"{g}dot{g}"), ("(AT)", "."), ("%40", "."), ("&#64;", "&#46;"), ("＠", "．")])
    return dot.join(names) + at + dot.join(hosts), ".".join(names) + "@" + ".".join(hosts)


def number(rng):
    words = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
    d = [rng.randrange(10) for _ in range(rng.randrange(7, 12))]
    gap = rng.choice([" ", "-", "–", ", ", " ", "."])
    return gap.join(words[x] for x in d), "".join(map(str, d)), len(set(d)) > 2


def test_planted_identifiers_are_found_whole():
    rng = random.Random(1)
    for _ in range(600):
        parts, want, at = [], [], 0
        for _ in range(rng.randrange(1, 4)):
            lead = filler(rng) + " : "
            kind = rng.choice(["email", "phone", "card", "ip"])
            if kind == "email":
                shown, value = address(rng)
            elif kind == "phone":
                shown, value, enough = number(rng)
                if not enough:
                    continue
            elif kind == "card":
                shown = value = rng.choice(["4111 1111 1111 1111", "5500-0000-0000-0004"])
                if rng.random() < 0.5:
                    shown = shown.replace("-", "–").replace(" ", " ")
            else:
                value = ".".join(str(rng.randrange(1, 250)) for _ in range(4))
                shown = value.replace("1", "１") if rng.random() < 0.5 else value
            want.append((kind, value, at + len(lead), at + len(lead) + len(shown), shown != value))
            parts.append(lead + shown + " ; ")
            at += len(parts[-1])
        text = "".join(parts)
        assert pii.findings(text) == want, text
        assert len(pii.suspects(pa.array([text], pa.large_string()))) == (1 if want else 0) or not want


def test_findings_have_a_clue():
    rng = random.Random(2)
    bits = ["at", "dot", "@", ".", "(at)", "[dot]", "com", "ann", "five", "six", "seven", "-", "–", " ", " ", "\n", "12", "345", "6789", "+1", "GB29", "NWBK", "DE89", "3704", "_", ",", "а", "%40", "&#64;", "null", "zwei"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", " ", " "]) for _ in range(rng.randrange(3, 25))) for _ in range(30_000)]
    hit = set(pii.suspects(pa.array(texts, pa.large_string())).tolist())
    missed = [t for i, t in enumerate(texts) if i not in hit and pii.findings(t)]
    assert not missed, missed[:3]


def test_secrets_have_a_clue():
    rng = random.Random(3)
    bits = ["password", "api_key", "Token", "secret", "_prod", "-x", "=", ":", "=>", ":=", '"', "'", " ", " ", TOKEN, "aB3dE6gH9jK2", "http://", "u:pW12x@h.org", "AKIA" + "A1B2C3D4E5F6G7H8", "-----BEGIN RSA PRIVATE KEY-----", "xoxb-12345-abcdef", "%41", "\\u0041", "accessToken"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 9))) for _ in range(20_000)]
    hit = pc.match_substring_regex(pa.array(texts), secrets._CLUE).to_pylist()
    missed = [t for t, h in zip(texts, hit) if not h and secrets.findings(t)]
    assert not missed, missed[:3]


PACKED = {"gzip": gzip.compress, "zlib": zlib.compress, "bzip2": bz2.compress, "xz": lzma.compress, "zstd": zstandard.compress}


@pytest.mark.parametrize("name", ["gzip", "bzip2", "xz", "zstd"])
def test_later_members_are_read(name):
    data = PACKED[name](b"nothing here") + PACKED[name](b"x " + TOKEN.encode())
    assert [f[:2] for f in secrets.findings(f"see {base64.b64encode(data).decode()} end")] == [("github_token", TOKEN)]


def test_oversized_layers_are_scanned_to_the_bound():
    bomb = base64.b64encode(gzip.compress(TOKEN.encode() + b" " + b"a" * 5000)).decode()
    assert {(f[0], f[1]) for f in secrets.findings(f"x {bomb} y", max_bytes=1000)} == {("oversized", ""), ("github_token", TOKEN)}
    heavy = base64.b64encode(lzma.compress(b"x" * 99, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": 1 << 29}])).decode()
    assert [f[0] for f in secrets.findings(f"x {heavy} y")] == ["oversized"]


def test_values_have_no_greatest_length():
    rng = random.Random(4)
    value = "".join(rng.choice("abcXYZ0123456789") for _ in range(3000))
    assert secrets.findings(f'password = "{value}"')[0][1:4] == (value, 12, 3012)
    assert secrets.findings("t ghp_" + value)[0][1] == "ghp_" + value
    assert secrets.findings(f"http://{'u' * 90}:{value}@h.org")[0][0] == "url_password"


def wrapped(rng, text):
    """``text`` in layers, and their names from the outermost."""
    names = []
    for _ in range(rng.randrange(4)):
        name = rng.choice(["base64", "url", "unicode", "hex", *PACKED])
        data = text.encode()
        if name == "url":
            text = "".join(f"%{b:02X}" for b in data)
        elif name == "unicode":
            text = "".join(f"\\u{ord(c):04x}" for c in text)
        elif name == "hex":
            text = data.hex()
        elif name == "base64":
            text = base64.b64encode(data).decode()
        else:
            text, name = base64.b64encode(PACKED[name](data)).decode(), f"base64/{name}"
        names.insert(0, name)
    return text, "/".join(names)


def test_planted_secrets_and_nothing_else(spark):
    rng = random.Random(5)
    rows, want = [], set()
    for i in range(300):
        text = filler(rng) + "\n"
        for k in range(rng.randrange(3)):
            token = "ghp_" + "".join(rng.choice("abcdefgXYZ0123456789") for _ in range(36))
            inner, names = wrapped(rng, token)
            at = len(text)
            text += inner + "\n" + filler(rng) + "\n"
            want.add((i, "github_token", token, at, at + len(inner)))
        rows.append((i, text))
    got = [tuple(r) for r in secrets.secrets(spark.createDataFrame([*rows, (None, None), (1000, "")], "doc_id bigint, text string")).collect()]
    assert len(want) > 200 and {g[:5] for g in got} == want and len(got) == len(want)
