"""The cleaning steps that need a scanner or a table of entities, as Arrow functions over batches."""

from __future__ import annotations

import html
import re
import unicodedata
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _mapped(fn):
    @F.arrow_udf(StringType())
    def run(texts: pa.Array) -> pa.Array:
        # one text at a time: a batch is held as Arrow's bytes, not as Python strings, too
        return pa.array((None if (x := t.as_py()) is None else fn(x) for t in texts), pa.string(), size=len(texts))

    return run


def without_spans(text: str, opening: str, closing: str) -> str:
    """Nested spans removed; a stray closing stays, an unclosed opening takes the rest."""
    out, depth, at = [], 0, 0
    for m in re.finditer(f"{re.escape(opening)}|{re.escape(closing)}", text):
        if m[0] == opening:
            if depth == 0:
                out.append(text[at : m.start()])
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                at = m.end()
    if depth == 0:
        out.append(text[at:])
    return "".join(out)


def _shown(inner: str) -> str:
    inner = inner.strip()
    if re.match("(?:file|image|category|media):", inner.lower()):
        return ""
    return inner.rpartition("|")[2].strip()


def wiki_links(text: str) -> str:
    """Links as their last segment, media as nothing; an unclosed link takes the rest."""
    out, depth, at = [], 0, 0
    for m in re.finditer(r"\[\[|\]\]", text):
        if m[0] == "[[":
            if depth == 0:
                out.append(text[at : m.start()])
                at = m.end()
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                out.append(_shown(text[at : m.start()]))
                at = m.end()
    out.append(_shown(text[at:]) if depth else text[at:])
    return "".join(out)


def slugify(title: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFKD", title) if not unicodedata.combining(c))
    return re.sub(r"[^A-Za-z0-9]+", "_", plain).strip("_").lower() or "article"


class _Markdown(HTMLParser):
    """Headings, paragraphs, bullets, links and emphasis; scripts, styles and the like go."""

    SKIP = frozenset({"script", "style", "meta", "head"})
    BLOCK = frozenset({"p", "div", "section", "article", "ul", "ol", "table", "tr", "nav", "blockquote"})

    def __init__(self, lang: str):
        super().__init__(convert_charrefs=True)
        self.lang, self.out, self.skipped, self.href = lang, [], 0, []

    def _url(self, url: str) -> str:
        if url.startswith("//"):
            return "https:" + url
        host = f"https://{self.lang}.wikipedia.org"
        return f"{host}/wiki/{url[2:]}" if url.startswith("./") else host + url if url.startswith("/") else url

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style", "head"):
            self.skipped += 1
        elif tag == "link" and "mw:PageProp/Category" in (a.get("rel") or "") and a.get("href"):
            self.out.append(f"\nCategory: {a['href']}\n")
        elif self.skipped:
            return
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag == "br":
            self.out.append("\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "a":
            self.href.append(self._url(a["href"]) if a.get("href") else None)
            self.out.append("[" if self.href[-1] else "")
        elif tag in self.BLOCK:
            self.out.append("\n\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head"):
            self.skipped = max(0, self.skipped - 1)
        elif self.skipped:
            return
        elif re.fullmatch("h[1-6]", tag) or tag in self.BLOCK:
            self.out.append("\n\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "a" and self.href:
            url = self.href.pop()
            self.out.append(f"]({url})" if url else "")

    def handle_data(self, data):
        if not self.skipped:
            self.out.append(re.sub(r"\s+", " ", data))


def to_markdown(page: str, lang: str = "en") -> str:
    parser = _Markdown(lang)
    parser.feed(page)
    parser.close()
    text = "".join(parser.out).replace("\xa0", " ")
    text = re.sub(r"\n{4,}", "\n\n\n", text)
    return re.sub(r"[ \t]+\n", "\n", text).strip() + "\n"


_decoded = _mapped(lambda t: html.unescape(unicodedata.normalize("NFC", t)))
_nfc = _mapped(lambda t: unicodedata.normalize("NFC", t))
_unwrapped = _mapped(lambda t: wiki_links(without_spans(without_spans(t, "{{", "}}"), "{|", "|}")))
_slug = _mapped(slugify)
_markdown = _mapped(to_markdown)


def decoded(text: Column) -> Column:
    """NFC, then HTML entities."""
    return _decoded(text)


def nfc(text: Column) -> Column:
    return F.coalesce(_nfc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def unwrapped(text: Column) -> Column:
    """Templates and tables removed, wiki links shown."""
    return _unwrapped(text)


def slug(title: Column) -> Column:
    return _slug(title)


def markdown(page: Column) -> Column:
    return _markdown(page)
