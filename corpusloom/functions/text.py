"""Text functions as column expressions: pretokens, units, normalization, markup removal.

Regular expressions carry ``(?d)`` where only a line feed ends a line, and ``(?U)`` where white space and
word boundaries are Unicode's.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "▁"
#: White space of the pretokenizer: Unicode separators and five ASCII controls.
WS = r"\p{Z}\t\n\r\f\x0B"
JOINERS = "‌‍"
PRETOKEN = rf" ?(?:[a-zA-Z\p{{L}}\p{{M}}{JOINERS}]++|\p{{N}}++|[^\p{{L}}\p{{M}}\p{{N}}{WS}{JOINERS}])"
WORD_LIKE = rf"^{MARK}?[\p{{L}}\p{{M}}\p{{N}}{JOINERS}]"
UNIT = r"(?U)[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\s]"
#: White space as Python's str.isspace has it.
ANY_SPACE = r"\s\x1c-\x1f"


def single_blanks(text: Column) -> Column:
    return F.regexp_replace(text, rf"[{WS}&&[^ ]][{WS}]*+| [{WS}]++", " ")


def raw_pretokens(text: Column) -> Column:
    """Pretokens with at most one blank before each, where the mark will be. Nothing is done to each token by a regular expression."""
    return F.regexp_extract_all(single_blanks(text), F.lit(PRETOKEN), F.lit(0))


def marked(token: Column) -> Column:
    """A raw pretoken with its mark: no pretoken has a blank elsewhere."""
    return F.replace(token, F.lit(" "), F.lit(MARK))


def pretokens(text: Column) -> Column:
    """Word runs, digit runs and single punctuation; a mark replaces the white space before a token."""
    return F.transform(raw_pretokens(text), marked)


def joined_pretokens(text: Column) -> Column:
    """All pretokens one after the other: nothing but blanks at the end is in none."""
    return F.replace(F.rtrim(single_blanks(text)), F.lit(" "), F.lit(MARK))


def char_kind(ch: Column) -> Column:
    """word, digit, space or punct, for one character."""
    return (
        F.when(ch.rlike(rf"^[\p{{L}}\p{{M}}{JOINERS}]"), "word")
        .when(ch.rlike(r"^\p{N}"), "digit")
        .when(ch.rlike(rf"^[{WS}]"), "space")
        .otherwise("punct")
    )


def is_word_like(token: Column) -> Column:
    return token.rlike(WORD_LIKE)


def faithful_units(text: Column) -> Column:
    return F.regexp_count(text, F.lit(UNIT))


def left_of(text: Column, others: str) -> Column:
    """How many characters are left without those of the class ``others``: no list of matches is made, as ``regexp_count`` makes."""
    return F.length(F.regexp_replace(text, f"{others}++", "")).cast("bigint")


def codepoints(word: Column) -> Column:
    return F.split(word, "")


def adjacent_pairs(symbols: Column) -> Column:
    """array<struct(left, right)> of neighbours, overlapping ones included."""
    n = F.size(symbols)
    pairs = F.zip_with(F.slice(symbols, F.lit(1), n - 1), F.slice(symbols, F.lit(2), n - 1), lambda a, b: F.struct(a.alias("left"), b.alias("right")))
    return F.when(n >= 2, pairs).otherwise(F.slice(F.zip_with(symbols, symbols, lambda a, b: F.struct(a.alias("left"), b.alias("right"))), 1, 0))


def merged_symbols(symbols: Column, left: Column, right: Column) -> Column:
    """``symbols`` with the pair joined, from the left, without overlaps."""
    empty = F.slice(symbols, 1, 0)

    def step(done: Column, s: Column) -> Column:
        joins = (F.size(done) > 0) & (F.element_at(done, -1) == left) & (s == right)
        return F.when(joins, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat(left, right)))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(symbols, empty, step)


def merged_pairs(symbols: Column, pairs: list[tuple[str, str]]) -> Column:
    """``symbols`` with all ``pairs`` joined, from the left, without overlaps; no two pairs have a symbol in common."""
    before = F.create_map(*[F.lit(x) for left, right in pairs for x in (right, left)])

    def step(done: Column, s: Column) -> Column:
        last = F.when(F.size(done) > 0, F.element_at(done, -1))
        joins = F.coalesce(F.try_element_at(before, s) == last, F.lit(False))
        return F.when(joins, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat(last, s)))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(symbols, F.slice(symbols, 1, 0), step)


def normalize_for_roundtrip(text: Column) -> Column:
    """What encoding and decoding keep of a text: each run of white space as one blank, none at the end."""
    return F.rtrim(F.regexp_replace(text, rf"(?U)[{ANY_SPACE}]+", " "))


def strip_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<!--.*?-->", "")


def strip_refs(text: Column) -> Column:
    """Citations with their content; the paired form first, whose opening also fits a self-closing tag."""
    return F.regexp_replace(F.regexp_replace(text, r"(?isU)<ref\b[^>]*>.*?</ref\s*>", ""), r"(?iU)<ref\b[^>]*/>", "")


def external_links(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\[https?://[^\s\]]+(?:\s+([^\]]*?)\s*)?\]", "$1")


def wiki_formatting(text: Column) -> Column:
    for n in (5, 3, 2):
        text = F.regexp_replace(text, rf"(?d)'{{{n}}}(.*?)'{{{n}}}", "$1")
    text = F.regexp_replace(text, r"(?dmU)^={2,6}\s*(.*?)\s*={2,6}[ \t]*$", "$1")
    text = F.regexp_replace(text, r"(?dm)^-{4,}[ \t]*$", "")
    return F.regexp_replace(text, r"(?dm)^[ \t]*[*#;:]+[ \t]*", "")


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"<[^>]+>", "")


def clean_whitespace(text: Column) -> Column:
    text = F.regexp_replace(text, r"[ \t]+", " ")
    text = F.regexp_replace(text, rf"(?U)[{ANY_SPACE}&&[^\n]]+(?=\n|\z)", "")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return F.regexp_replace(text, r"^[ \t\n]+|[ \t\n]+\z", "")


def normalize_markdown(text: Column) -> Column:
    text = F.replace(text, F.lit(" "), F.lit(" "))
    text = F.regexp_replace(F.regexp_replace(text, r"\n{4,}", "\n\n\n"), r"[ \t]+\n", "\n")
    return F.concat(F.regexp_replace(text, rf"(?U)^[{ANY_SPACE}]+|[{ANY_SPACE}]+\z", ""), F.lit("\n"))


def strip_scripts(html: Column) -> Column:
    """Script and style blocks with their content, and meta and link tags."""
    html = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "")
    return F.regexp_replace(html, r"(?i)<(?:meta|link)\b[^>]*>", "")


def absolutize(url: Column, lang: Column) -> Column:
    """A link of a page made absolute: protocol-relative, ``./`` and root-relative forms."""
    host = F.concat(F.lit("https://"), lang, F.lit(".wikipedia.org"))
    return (
        F.when(url.startswith("//"), F.concat(F.lit("https:"), url))
        .when(url.startswith("./"), F.concat(host, F.lit("/wiki/"), F.substring(url, 3, 1 << 30)))
        .when(url.startswith("/"), F.concat(host, url))
        .otherwise(url)
    )


def clean_text(text: Column) -> Column:
    """The whole cleaning. The two Python islands see only the texts that need them; other rows pass as nulls."""
    from corpusloom.functions import markup

    text = F.coalesce(markup.decoded(F.when(text.rlike(r"[^\x00-\x7F]|&"), text)), text)
    text = strip_refs(strip_comments(text))
    text = F.coalesce(markup.unwrapped(F.when(text.contains("{{") | text.contains("{|") | text.contains("[["), text)), text)
    for step in (external_links, wiki_formatting, strip_tags, clean_whitespace):
        text = step(text)
    return text


def parse_spec(spec: Column) -> Column:
    """'en=3.0, te=1.5' as map<string,double>."""
    pairs = F.filter(F.split(spec, ","), lambda p: F.trim(p) != "")
    keys = F.transform(pairs, lambda p: F.trim(F.split_part(p, F.lit("="), F.lit(1))))
    values = F.transform(pairs, lambda p: F.trim(F.split_part(p, F.lit("="), F.lit(2))).cast("double"))
    return F.map_from_arrays(keys, values)


def redact(text: Column) -> Column:
    for kind, pattern in PII:
        text = F.regexp_replace(text, pattern, f"<{kind}>")
    return text


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("phone", r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}"),
    ("ip", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"),
    ("card", r"\b[0-9]{16}\b"),
)
SECRET = r"(?:token|secret|password|api_key) ?= ?\"[A-Za-z0-9+/_-]{16,}\"|AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}"
