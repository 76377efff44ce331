"""Line-wrapped, assigned, multi-member and truncated layers."""

import base64
import bz2
import gzip
import lzma
import random
import textwrap
import zlib

import pytest
import zstandard

from corpusloom.llm import secrets

TOKEN = "ghp_" + "aB3dE6gH9jK2mN5pQ8sT1vW4yZ7bC0eF3hI6"
NOISE = "".join(random.Random(4).choices("abcdefghij klmnop", k=900))


def tokens(text):
    return [(f[1], f[4]) for f in secrets.findings(text) if f[0] == "github_token"]


@pytest.mark.parametrize("width", [64, 76])
@pytest.mark.parametrize("at", range(0, 60, 7))
def test_secrets_across_lines(width, at):
    for plain in (b"x" * at + b" " + TOKEN.encode() + b" and some more words to fill the line", gzip.compress((NOISE + " " + TOKEN + " " + NOISE).encode())):
        block = "\n".join(textwrap.wrap(base64.b64encode(plain).decode(), width))
        assert [t for t, _ in tokens(f"head\n{block}\n\ntail")] == [TOKEN]
        assert [t for t, _ in tokens(f"-----BEGIN DATA-----\n{block}\n-----END DATA-----")] == [TOKEN]


def test_separate_lines_and_assigned_payloads():
    line = base64.b64encode(f"this line holds {TOKEN} ok".encode()).decode().rstrip("=")
    assert tokens(f"payload={line}") == [(TOKEN, "base64")]
    assert tokens(f"{line}\nand then plain words") == [(TOKEN, "base64")]


@pytest.mark.parametrize("name, pack", [("gzip", gzip.compress), ("zlib", zlib.compress), ("bzip2", bz2.compress), ("xz", lzma.compress), ("zstd", zstandard.ZstdCompressor().compress)])
def test_all_members_and_truncated_streams(name, pack):
    data = pack(b"first member ") + pack(f" {TOKEN} ".encode())
    assert tokens(base64.b64encode(data).decode()) == [(TOKEN, f"base64/{name}")]
    assert secrets._inflate(data + b"trailing", 1000) == (name, f"first member  {TOKEN} ".encode())
    assert secrets._inflate(pack(NOISE.encode())[:-6], 1000)[0] == f"{name}-truncated"
    with pytest.raises(secrets.Oversized):
        secrets._inflate(data, 20)
