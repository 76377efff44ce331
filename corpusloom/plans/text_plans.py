"""Queries over texts: pretokens, word counts, language weights, vocabularies, cleaning.

Texts are always reduced to distinct words by a partial aggregation before anything else is done with them, so
what is shuffled grows with the vocabulary of a partition and not with its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import markup
from corpusloom.functions import numeric as nm
from corpusloom.functions import text as tx
from corpusloom.operators import counts
from corpusloom.sources import static
from corpusloom.sources.tables import table

_W = r"\p{Z}\t\n\r\f\x0B"
_J = r"\x{200C}\x{200D}"
_TOKEN = rf"[{_W}]*(?:[\p{{L}}\p{{M}}{_J}]+|\p{{N}}+|[^\p{{L}}\p{{M}}\p{{N}}{_W}{_J}])"
SQL = {
    "toks": f"SELECT doc_id, lang, unnest(list_transform(regexp_extract_all(text, '{_TOKEN}'), lambda x: regexp_replace(x, '^[{_W}]+', '▁'))) AS word FROM documents",
    "wordlike": rf"regexp_matches(word, '^▁?[\p{{L}}\p{{M}}\p{{N}}{_J}]')",
    "units": r"len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\s]'))",
}
SQL["raw"] = f"SELECT lang, count(*) AS c FROM ({SQL['toks']}) WHERE {SQL['wordlike']} GROUP BY lang"
SQL["weights"] = f"SELECT lang, c AS words, (sqrt(c) / sum(sqrt(c)) OVER ()) / (c / sum(c) OVER ()) AS weight FROM ({SQL['raw']})"
SQL["weighted"] = f"""SELECT word, sum(greatest(1, CAST(round_even(n * weight, 0) AS BIGINT)))::BIGINT AS freq
FROM (SELECT lang, word, count(*) AS n FROM ({SQL["toks"]}) GROUP BY lang, word) JOIN ({SQL["weights"]}) USING (lang) GROUP BY word"""


def _docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "text")


def pretoken_stats(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    units = docs.groupBy("lang").agg(F.sum(tx.faithful_units(F.col("text")).cast("bigint")).alias("units"))
    words = (
        counts.language_words(docs).where(tx.is_word_like(F.col("word")))
        .groupBy("lang").agg(F.sum("freq").alias("words"), F.count("*").alias("distinct_words"))
    )
    return words.join(units, "lang").select("lang", "words", "distinct_words", "units")


def word_frequencies(spark, sf_dir):
    return counts.word_frequencies(_docs(spark, sf_dir))


def language_weights(spark, sf_dir):
    words = counts.language_words(_docs(spark, sf_dir))
    return counts.language_weights(words).select("lang", "words", F.round("weight", 8).alias("weight"))


def weighted_frequencies(spark, sf_dir):
    return counts.weighted_frequencies(_docs(spark, sf_dir))


def language_stats(spark, sf_dir):
    """Documents, words and weight of every language of the table and of those asked for; one without documents stays, with zeros."""
    docs = _docs(spark, sf_dir)
    asked = spark.createDataFrame([("en",), ("hi",), ("te",), ("ta",)], "lang string").unionByName(docs.select("lang")).distinct()
    number = docs.groupBy("lang").agg(F.count("*").alias("num_documents"))
    weights = counts.language_weights(counts.language_words(docs))
    out = asked.join(number, "lang", "left").join(weights, "lang", "left")
    return out.select(
        F.col("lang").alias("language"), F.coalesce("num_documents", F.lit(0)).alias("num_documents"),
        F.coalesce("words", F.lit(0)).alias("raw_word_count"), F.round(F.coalesce("weight", F.lit(0.0)), 8).alias("weight"),
    )


def base_vocabulary(spark, sf_dir):
    return counts.base_vocabulary(counts.word_frequencies(_docs(spark, sf_dir)))


def pair_counts(spark, sf_dir):
    return counts.pair_counts(counts.word_frequencies(_docs(spark, sf_dir)))


def best_pair(spark, sf_dir):
    return counts.best_pairs(pair_counts(spark, sf_dir), 1)


def char_kinds(spark, sf_dir):
    """Characters by kind: each distinct character is classified once."""
    chars = _docs(spark, sf_dir).select(F.explode(tx.codepoints(F.col("text"))).alias("ch")).groupBy("ch").agg(F.count("*").alias("n"))
    return chars.groupBy(tx.char_kind(F.col("ch")).alias("kind")).agg(F.sum("n").alias("chars"), F.count("*").alias("distinct_chars"))


def normalized_texts(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select(
        "doc_id", F.md5(markup.nfc(t)).alias("nfc"), F.md5(tx.normalize_for_roundtrip(t)).alias("roundtrip"),
        F.md5(tx.normalize_markdown(t)).alias("markdown"), F.md5(tx.clean_whitespace(t)).alias("whitespace"),
    )


def stripped_pages(spark, sf_dir):
    """Comments, citations, external links, tags and spare white space removed, step by step."""
    t = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.md5(tx.strip_comments(t)).alias("comments"), F.md5(tx.strip_refs(t)).alias("refs"),
        F.md5(tx.external_links(t)).alias("links"), F.md5(tx.strip_tags(t)).alias("tags"), F.md5(tx.wiki_formatting(t)).alias("formatting"),
    )


def cleaned_pages(spark, sf_dir):
    """The whole cleaning; pages that clean to nothing go."""
    out = table(spark, sf_dir, "pages").select("page_id", tx.clean_text(tx.strip_scripts(F.col("html"))).alias("text"))
    return out.where("text <> ''")


def page_markdown(spark, sf_dir):
    md = markup.markdown(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", md.alias("markdown")).withColumns({"units": tx.faithful_units(F.col("markdown")), "chars": F.length("markdown")})


def page_links(spark, sf_dir):
    """Links of the pages, made absolute."""
    hrefs = F.regexp_extract_all("html", F.lit('(?:href|src)="([^"]*)"'), F.lit(1))
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(hrefs).alias("href"))
    return links.groupBy("page_id", tx.absolutize(F.col("href"), F.lit("en")).alias("url")).agg(F.count("*").alias("n"))


def page_slugs(spark, sf_dir):
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", markup.slug(title).alias("slug"))


def served_units(spark, sf_dir):
    """Faithful units and characters of each language; the largest and the least are marked over all languages."""
    units = tx.faithful_units(F.col("text")).cast("bigint")
    got = _docs(spark, sf_dir).groupBy("lang").agg(F.sum(units).alias("units"), F.sum(F.length("text").cast("bigint")).alias("chars"))
    ratio = F.col("chars") / F.col("units")
    every = Window.partitionBy(F.lit(0))
    return got.withColumn("ratio", F.round(ratio, 6)).withColumn("largest", F.col("ratio") == F.max("ratio").over(every)).withColumn("smallest", F.col("ratio") == F.min("ratio").over(every))


def language_table(spark, sf_dir):
    """Languages as they are shown: names, numbers with commas, shares and ratios with fixed digits."""
    docs = _docs(spark, sf_dir)
    got = docs.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.length("text").cast("bigint")).alias("chars"), F.sum(tx.faithful_units(F.col("text")).cast("bigint")).alias("units"))
    share = F.col("docs") / F.sum("docs").over(Window.partitionBy(F.lit(0)))
    ratio = nm.safe_divide(F.col("chars"), F.col("units"))
    return got.select(static.display_name(F.col("lang")).alias("language"), nm.thousands(F.col("docs")).alias("docs"), nm.thousands(F.col("units")).alias("units"), nm.percent(share).alias("share"), nm.fixed(ratio, 4).alias("ratio"), nm.short(F.lit(1000.0) / F.col("docs")).alias("score"))


def corpus_totals(spark, sf_dir):
    """All pretokens, and how many different ones there are."""
    return counts.word_frequencies(_docs(spark, sf_dir)).agg(F.sum("freq").alias("total_words"), F.count("*").alias("distinct_words"))


def size_deltas(spark, sf_dir):
    """Characters of each language with one to six sixths of the documents, and what each sixth adds."""
    docs = _docs(spark, sf_dir).where("doc_id IS NOT NULL").groupBy("lang", (F.pmod("doc_id", F.lit(6)) + 1).cast("int").alias("size")).agg(F.sum(F.length("text").cast("bigint")).alias("added"))
    by = Window.partitionBy("lang").orderBy("size")
    chars = F.sum("added").over(by)
    return docs.withColumn("chars", chars).select("lang", "size", "chars", (F.col("chars") - F.lag("chars").over(by)).alias("delta"))


def hapax_buckets(spark, sf_dir):
    n = F.col("freq")
    bucket = F.when(n == 1, "1").when(n < 5, "2-4").when(n < 20, "5-19").otherwise("20+")
    got = counts.word_frequencies(_docs(spark, sf_dir)).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("types"), F.sum("freq").alias("tokens"))
    return got.withColumn("share", F.round(F.col("types") / F.sum("types").over(Window.partitionBy(F.lit(0))), 8))


def next_tokens(spark, sf_dir):
    """Successive pretokens of a document that occur together at least twice."""
    tokens = _docs(spark, sf_dir).select(tx.raw_pretokens(F.col("text")).alias("t")).where("size(t) > 1")  # by themselves, or each use would tokenize again
    n = F.size("t") - 1
    pairs = tokens.select(F.inline(F.arrays_zip(F.slice("t", F.lit(1), n).alias("left"), F.slice("t", F.lit(2), n).alias("right"))))
    return pairs.select(tx.marked(F.col("left")).alias("left"), tx.marked(F.col("right")).alias("right")).groupBy("left", "right").agg(F.count("*").alias("n")).where("n >= 2")


def valid_requests(spark, sf_dir):
    """Texts a request may hold (1 to 10,000 characters) and how many pretokens each has."""
    docs = _docs(spark, sf_dir).where(F.length("text").between(1, 10_000))
    return docs.select("doc_id", F.size(tx.pretokens(F.col("text"))).cast("bigint").alias("pretokens"))


QUERIES = {
    f.__name__: f
    for f in (
        pretoken_stats, word_frequencies, language_weights, weighted_frequencies, language_stats, base_vocabulary, pair_counts, best_pair,
        char_kinds, normalized_texts, stripped_pages, cleaned_pages, page_markdown, page_links, page_slugs, served_units, hapax_buckets,
        next_tokens, valid_requests, language_table, corpus_totals, size_deltas,
    )
}

_FREQ = f"SELECT word, count(*) AS freq FROM ({SQL['toks']}) GROUP BY word"
_PAIRS = f"""SELECT l AS "left", r AS "right", sum(freq)::BIGINT AS n FROM (SELECT freq, unnest(list_transform(range(1, len(word)), lambda i: word[i])) AS l, unnest(list_transform(range(1, len(word)), lambda i: word[i + 1])) AS r
FROM ({_FREQ})) GROUP BY ALL HAVING sum(freq) >= 2"""
_SPACED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '[ \t\r\f\v]+(\n|$)', '\1', 'g'), '\n{3,}', E'\n\n', 'g'), '^[ \t\n]+|[ \t\n]+$', '', 'g')"


def _replaced(text: str, *steps: tuple[str, str, str]) -> str:
    for pattern, by, flags in steps:
        text = f"regexp_replace({text}, '{pattern}', {by}, '{flags}')"
    return text


_CLEAN = _replaced("html", (r"<script\b[^>]*>.*?</script\s*>", "''", "gsi"), (r"<style\b[^>]*>.*?</style\s*>", "''", "gsi"), (r"<(?:meta|link)\b[^>]*>", "''", "gi"))
for _entity, _char in (("quot", '"'), ("middot", "·"), ("copy", "©"), ("amp", "&")):  # those that the pages have
    _CLEAN = f"replace({_CLEAN}, '&{_entity};', '{_char}')"
_CLEAN = _replaced(
    f"nfc_normalize({_CLEAN})",
    ("<!--.*?-->", "''", "gs"), (r"<ref\b[^>]*>.*?</ref\s*>", "''", "gsi"), (r"<ref\b[^>]*/>", "''", "gi"), (r"\[https?://[^\s\]]+(?:\s+([^\]]*?)\s*)?\]", r"'\1'", "g"),
    ("''{5}(.*?)''{5}", r"'\1'", "g"), ("''{3}(.*?)''{3}", r"'\1'", "g"), ("''{2}(.*?)''{2}", r"'\1'", "g"), (r"(?m)^={2,6}\s*(.*?)\s*={2,6}[ \t]*$", r"'\1'", "g"),
    (r"(?m)^-{4,}[ \t]*$", "''", "g"), (r"(?m)^[ \t]*[*#;:]+[ \t]*", "''", "g"), ("<[^>]+>", "''", "g"), (r"[ \t]+", "' '", "g"), (r"[ \t\r\f\v\x{a0}]+(\n|$)", r"'\1'", "g"), (r"\n{3,}", "E'\\n\\n'", "g"), (r"^[ \t\n]+|[ \t\n]+$", "''", "g"),
)
ORACLES: dict[str, str] = {
    "cleaned_pages": f"SELECT * FROM (SELECT page_id, {_CLEAN} AS text FROM pages) WHERE text <> ''",
    "pretoken_stats": f"""SELECT lang, words, distinct_words, units FROM (SELECT lang, count(*) AS words, count(DISTINCT word) AS distinct_words FROM ({SQL["toks"]}) WHERE {SQL["wordlike"]} GROUP BY lang)
JOIN (SELECT lang, sum({SQL["units"]})::BIGINT AS units FROM documents GROUP BY lang) USING (lang)""",
    "word_frequencies": _FREQ,
    "language_weights": f"SELECT lang, words, round(weight, 8) AS weight FROM ({SQL['weights']})",
    "weighted_frequencies": SQL["weighted"],
    "language_stats": f"""SELECT a.lang AS language, coalesce(n, 0) AS num_documents, coalesce(words, 0) AS raw_word_count, round(coalesce(weight, 0), 8) AS weight FROM (SELECT * FROM (VALUES ('en'), ('hi'), ('te'), ('ta')) v(lang) UNION SELECT lang FROM documents) a
LEFT JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY lang) USING (lang) LEFT JOIN ({SQL["weights"]}) USING (lang)""",
    "base_vocabulary": f"""SELECT '<pad>' AS token, 0 AS id UNION ALL SELECT '<bos>', 1 UNION ALL SELECT '<eos>', 2 UNION ALL SELECT '<unk>', 3 UNION ALL
SELECT token, CAST(3 + row_number() OVER (ORDER BY encode(token)) AS INT) FROM (SELECT DISTINCT unnest(string_split(word, '')) AS token FROM ({_FREQ}))""",
    "pair_counts": _PAIRS,
    "best_pair": f"""SELECT * FROM ({_PAIRS}) ORDER BY n DESC, encode("left"), encode("right") LIMIT 1""",
    "char_kinds": rf"""SELECT CASE WHEN regexp_matches(ch, '^[\p{{L}}\p{{M}}{_J}]') THEN 'word' WHEN regexp_matches(ch, '^\p{{N}}') THEN 'digit' WHEN regexp_matches(ch, '^[{_W}]') THEN 'space' ELSE 'punct' END AS kind,
sum(n)::BIGINT AS chars, count(*) AS distinct_chars FROM (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) GROUP BY ch) GROUP BY kind""",
    "normalized_texts": rf"""SELECT doc_id, md5(nfc_normalize(text)) AS nfc, md5(rtrim(regexp_replace(text, '[\s\x0B]+', ' ', 'g'))) AS roundtrip,
md5(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(160), ' '), '\n{{4,}}', E'\n\n\n', 'g'), '[ \t]+\n', E'\n', 'g'), '^[\s\x0B]+|[\s\x0B]+$', '', 'g') || E'\n') AS markdown, md5({_SPACED}) AS whitespace FROM documents""",
    "stripped_pages": r"""SELECT page_id, md5(regexp_replace(html, '<!--.*?-->', '', 'gs')) AS comments,
md5(regexp_replace(regexp_replace(html, '<ref\b[^>]*>.*?</ref\s*>', '', 'gsi'), '<ref\b[^>]*/>', '', 'gi')) AS refs,
md5(regexp_replace(html, '\[https?://[^\s\]]+(?:\s+([^\]]*?)\s*)?\]', '\1', 'g')) AS links, md5(regexp_replace(html, '<[^>]+>', '', 'g')) AS tags,
md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '''{5}(.*?)''{5}', '\1', 'g'), '''{3}(.*?)''{3}', '\1', 'g'), '''{2}(.*?)''{2}', '\1', 'g'), '(?m)^={2,6}\s*(.*?)\s*={2,6}[ \t]*$', '\1', 'g'), '(?m)^-{4,}[ \t]*$', '', 'g'), '(?m)^[ \t]*[*#;:]+[ \t]*', '', 'g')) AS formatting FROM pages""",
    "page_links": """SELECT page_id, CASE WHEN starts_with(h, '//') THEN 'https:' || h WHEN starts_with(h, './') THEN 'https://en.wikipedia.org/wiki/' || h[3:] WHEN starts_with(h, '/') THEN 'https://en.wikipedia.org' || h ELSE h END AS url,
count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?:href|src)="([^"]*)"', 1)) AS h FROM pages) GROUP BY ALL""",
    "served_units": f"""SELECT *, ratio = max(ratio) OVER () AS largest, ratio = min(ratio) OVER () AS smallest FROM (SELECT lang, units, chars, round(chars / units, 6) AS ratio
FROM (SELECT lang, sum({SQL["units"]})::BIGINT AS units, sum(length(text))::BIGINT AS chars FROM documents GROUP BY lang))""",
    "hapax_buckets": f"""SELECT bucket, types, tokens, round(types / sum(types) OVER (), 8) AS share FROM (SELECT CASE WHEN freq = 1 THEN '1' WHEN freq < 5 THEN '2-4' WHEN freq < 20 THEN '5-19' ELSE '20+' END AS bucket,
count(*) AS types, sum(freq)::BIGINT AS tokens FROM ({_FREQ}) GROUP BY 1)""",
    "next_tokens": f"""SELECT a AS "left", b AS "right", count(*) AS n FROM (SELECT unnest(l[:-2]) AS a, unnest(l[2:]) AS b FROM (SELECT list_transform(regexp_extract_all(text, '{_TOKEN}'), lambda x: regexp_replace(x, '^[{_W}]+', '▁')) AS l FROM documents) WHERE len(l) > 1)
GROUP BY ALL HAVING count(*) >= 2""",
    "language_table": f"""SELECT coalesce(name, lang) AS language, format('{{:,}}', docs) AS docs, format('{{:,}}', units) AS units, printf('%.1f', docs / sum(docs) OVER () * 100) || '%' AS share, printf('%.4f', chars / units) AS ratio,
regexp_replace(regexp_replace(printf('%.2f', 1000.0 / docs), '([.][0-9]*?)0+$', '\\1'), '[.]$', '') AS score FROM (SELECT lang, count(*) AS docs, sum(length(text)) AS chars, sum({SQL["units"]})::BIGINT AS units FROM documents GROUP BY lang)
LEFT JOIN (VALUES {", ".join(str(x) for x in static.NAMES.items())}) n(lang, name) USING (lang)""",
    "corpus_totals": f"SELECT sum(freq)::BIGINT AS total_words, count(*) AS distinct_words FROM ({_FREQ})",
    "size_deltas": """SELECT *, chars - lag(chars) OVER (PARTITION BY lang ORDER BY size) AS delta FROM (SELECT lang, size, (sum(added) OVER (PARTITION BY lang ORDER BY size))::BIGINT AS chars
FROM (SELECT lang, (doc_id % 6 + 1)::INT AS size, sum(length(text)) AS added FROM documents GROUP BY ALL))""",
    "page_slugs": r"""SELECT page_id, coalesce(nullif(trim(lower(regexp_replace(strip_accents(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '[^A-Za-z0-9]+', '_', 'g')), '_'), ''), 'article') AS slug FROM pages""",
    "valid_requests": f"SELECT doc_id, len(regexp_extract_all(text, '{_TOKEN}')) AS pretokens FROM documents WHERE length(text) BETWEEN 1 AND 10000",
}
