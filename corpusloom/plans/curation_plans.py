"""Curation of a corpus: tagging, deduplication, thresholds, rebalancing, curriculum, conversations, chunks.

The semantics are this engine's own where only a description exists; thresholds are parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import minhash, ranks
from corpusloom.operators.components import components
from corpusloom.sources.shared import written
from corpusloom.sources.tables import table

STOP = {"en": ("the", "and", "of"), "de": ("der", "und", "die"), "fr": ("le", "et", "la"), "es": ("el", "que", "y")}
CHUNK, STRIDE = 200, 150
LICENSE = r"(?i)licensed under|released under|SPDX-License-Identifier"


def _docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


def content_hashes(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", F.md5("text").alias("md5"), t.rlike(LICENSE).alias("licensed"), t.rlike(tx.SECRET).alias("secret"))


def provenance(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).groupBy("source").agg(
        F.count("*").alias("docs"), F.sum(F.length("text").cast("bigint")).alias("chars"),
        F.sum(t.rlike(LICENSE).cast("bigint")).alias("licensed"), F.sum(t.rlike(tx.SECRET).cast("bigint")).alias("secrets"),
    )


def language_id(spark, sf_dir):
    """The language whose stop words are most frequent; documents below the confidence go to review."""
    words = tx.pretokens(F.lower("text"))
    found = _docs(spark, sf_dir).select("doc_id", "lang", F.transform(words, lambda w: F.ltrim(w, F.lit(tx.MARK))).alias("w"))
    score = lambda lang: F.size(F.filter("w", lambda w: w.isin(*STOP[lang])))
    found = found.select("doc_id", "lang", *(score(c).alias(c) for c in STOP))
    best, total = F.greatest(*STOP), sum((F.col(c) for c in STOP), F.lit(0))
    guess = F.coalesce(*[F.when(F.col(c) == best, F.lit(c)) for c in STOP])
    sure = F.coalesce(F.try_divide(best.cast("double"), total), F.lit(0.0))
    return found.select("doc_id", "lang", F.when(total > 0, guess).alias("guess"), F.round(sure, 6).alias("confidence"), ((total == 0) | (sure < 0.6)).alias("review"))


def exact_dedup(spark, sf_dir):
    """The first document of each content."""
    return _docs(spark, sf_dir).groupBy(F.md5("text").alias("md5")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def known_bad_removed(spark, sf_dir):
    """Documents whose content isn't on the list of hashes to remove: here, contents that occur more than once."""
    docs = _docs(spark, sf_dir).select("doc_id", F.md5("text").alias("md5"))
    bad = docs.groupBy("md5").count().where("count > 1").select("md5")
    return docs.join(bad, "md5", "left_anti")


def split_overlap(spark, sf_dir):
    """Contents that more than one source holds: splits made by source would share them."""
    docs = _docs(spark, sf_dir).select(F.md5("text").alias("md5"), "source")
    return docs.groupBy("md5").agg(F.countDistinct("source").alias("sources"), F.count("*").alias("docs")).where("sources > 1")


def line_dedup(spark, sf_dir):
    """Documents without the lines of 20 characters or more that six or more documents hold."""
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    often = lines.where("length(line) >= 20").select("doc_id", F.md5("line").alias("h")).distinct().groupBy("h").count().where("count > 5").select("h")
    kept = lines.withColumn("h", F.md5("line")).join(often, "h", "left_anti")
    whole = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    return whole.select("doc_id", F.md5(F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("md5"), F.size("l").cast("bigint").alias("lines"))


def minhash_pairs(spark, sf_dir):
    """Near-duplicate pairs of different contents by MinHash bands, verified by the Jaccard index of their shingles of five words.

    Documents of equal shingles are one content, named by the least of their ids, so that copies make no pairs; with the pairs' components.
    """
    return minhash_links(near_shingles(_docs(spark, sf_dir)))[0]


def minhash_groups(spark, sf_dir):
    """One row for each document that has words: its content, how many documents share that, how many contents are near it, and its group."""
    return minhash_links(near_shingles(_docs(spark, sf_dir)))[1]


def near_shingles(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, s): the distinct hashes of runs of ``k`` words, of documents with words."""
    word = r"[\p{L}\p{M}\p{N}]+"
    words = F.array_join(F.regexp_extract_all(F.lower("text"), F.lit(word), F.lit(0)), " ")
    return docs.where(F.lower("text").rlike(word)).select("doc_id", minhash.shingles(k)(words).alias("s"))


def minhash_links(shingled: DataFrame, bands: int = 16, rows: int = 3, threshold: float = 0.7, block: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(a, b, jaccard, comp) and (doc_id, content, copies, links, comp): the pairs of contents that share a band's bucket and reach the threshold, and the documents.

    Equal shingle sets are one content, with the least id of their documents as its name. A bucket is
    joined with itself in blocks of about ``block`` contents, so that none is one task's work. ``comp`` is the least id of the component.
    """
    signed = written(shingled.where("doc_id IS NOT NULL").select("doc_id", "s", minhash.signed(bands, rows)(F.col("s")).alias("k")).select("doc_id", "s", "k.keys", "k.content"))
    # shingles stay where they are, but for those of sets that are compared
    sets = written(signed.select("doc_id", "content", "keys", F.size("s").alias("n")).groupBy("content").agg(F.min("doc_id").alias("id"), F.countDistinct("doc_id").alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys")))
    banded = sets.select("content", "n", F.explode("keys").alias("key"))
    full = banded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key", F.ceil(F.col("c") / block).alias("parts"))
    cells = banded.join(full, "key").withColumn("part", F.pmod(F.xxhash64("content"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    cells = cells.select("key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "content", "n")
    right = cells.select("key", "lo", "hi", F.col("part").alias("part2"), F.col("content").alias("y"), F.col("n").alias("n2"))
    # an index is at most the smaller set over the larger one; the rounding below is allowed for
    may = (F.least("n", "n2") >= (threshold - 1e-6) * F.greatest("n", "n2")) & (F.col("content") < F.col("y")) & ((F.col("part") != F.col("part2")) | (F.col("lo") == F.col("hi")))
    pairs = written(cells.join(right, ["key", "lo", "hi"]).where(may).select(F.col("content").alias("x"), "y").distinct())
    asked = written(pairs.select(F.col("x").alias("content")).union(pairs.select("y")).distinct())
    held = written(signed.select("content", "s").join(ranks.sided(asked), "content", "left_semi").groupBy("content").agg(F.first("s").alias("s")).join(sets.select("content", "id"), "content"))
    side = lambda c: held.select(F.col("content").alias(c), F.col("s").alias(f"s{c}"), F.col("id").alias(f"i{c}"))
    same = F.size(F.array_intersect("sx", "sy"))
    near = pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "ix", "iy", F.round(same / (F.size("sx") + F.size("sy") - same), 6).alias("jaccard"))
    near = written(near.where(F.col("jaccard") >= threshold))
    # one id may have several contents, which it then joins
    links = near.select(F.col("ix").alias("a"), F.col("iy").alias("b")).unionByName(signed.join(sets.select("content", "id"), "content").select(F.col("id").alias("a"), F.col("doc_id").alias("b")).where("a <> b").distinct())
    comps = written(components(links))
    comp_of = lambda c: comps.select(F.col("node").alias(c), "comp")
    found = near.select(F.least("ix", "iy").alias("a"), F.greatest("ix", "iy").alias("b"), "jaccard").where("a <> b").join(comp_of("a"), "a").select("a", "b", "jaccard", "comp")
    degree = near.select(F.col("x").alias("content")).unionByName(near.select(F.col("y").alias("content"))).groupBy("content").agg(F.count("*").alias("links"))
    of = sets.select("content", "id", "copies").join(degree, "content", "left")
    docs = signed.select("doc_id", "content").distinct().join(of, "content").join(comp_of("doc_id"), "doc_id", "left")
    return found, docs.select("doc_id", F.col("id").alias("content"), "copies", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"), F.coalesce("comp", "doc_id").alias("comp"))


def benchmark_overlap(spark, sf_dir):
    """Documents that share a run of 13 words with a benchmark item; runs go as hashes of 64 bits, those of the benchmark to every task while their number allows."""
    words = lambda df, key: df.select(key, F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("w")).where("size(w) >= 13")
    runs = lambda df, key: words(df, key).select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 12), lambda i: F.xxhash64(F.slice("w", i, 13)))).alias("g"))
    items = written(runs(table(spark, sf_dir, "benchmark"), "item_id").select("g").distinct())
    return runs(_docs(spark, sf_dir), "doc_id").join(ranks.sided(items), "g", "left_semi").groupBy("doc_id").agg(F.count("*").alias("runs"))


def quality_features(spark, sf_dir):
    """Surface features, and the mean negative log likelihood of a document's words under the corpus' unigrams."""
    docs = _docs(spark, sf_dir)
    words = written(docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("n")))
    model = words.groupBy("w").agg(F.sum("n").alias("c"))
    total = words.agg(F.sum("n")).first()[0] or 1
    model = model.select("w", "c", (-F.log(F.col("c") / F.lit(total))).alias("nll"))
    scored = ranks.joined_by_frequency(words, model, "w", "c").groupBy("doc_id").agg(F.round(F.sum(F.col("n") * F.col("nll")) / F.sum("n"), 6).alias("nll"), F.sum("n").alias("words"), F.count("*").alias("distinct_words"))
    t = F.col("text")
    surface = docs.select(
        "doc_id", tx.left_of(t, r"[a-zA-Z\p{L}\p{N}\s]").alias("symbols"), tx.left_of(t, "[^A-Z]").alias("capitals"), (tx.left_of(t, r"[^\n]") + 1).alias("lines"),
    )
    return surface.join(scored, "doc_id", "left")


def calibrated_thresholds(spark, sf_dir):
    """Per language: the lower tenth of good documents' lengths, and how many documents each keeps at least."""
    docs = _docs(spark, sf_dir).select("doc_id", "lang", "n_chars")
    good = docs.join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id")
    limit = good.groupBy("lang").agg(F.round(F.percentile("n_chars", 0.1), 6).alias("threshold"), F.count("*").alias("good"))
    kept = docs.join(F.broadcast(limit), "lang").groupBy("lang").agg(F.sum((F.col("n_chars") >= F.col("threshold")).cast("bigint")).alias("kept"), F.count("*").alias("docs"))
    return limit.join(kept, "lang").withColumn("floor_met", F.col("kept") * 2 >= F.col("docs"))


def redacted(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(tx.redact(F.col("text"))).alias("md5"), *(F.regexp_count("text", F.lit(p)).cast("bigint").alias(k) for k, p in tx.PII))


def _draw(key: str):
    """A number in [0, 1) that depends on the id alone."""
    return F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def rebalanced(spark, sf_dir):
    """Documents kept so that every source has equal characters in expectation, by a hash of the id."""
    docs = _docs(spark, sf_dir).select("doc_id", "source", "n_chars")
    of = docs.groupBy("source").agg(F.sum("n_chars").alias("c"))
    of = written(of.crossJoin(F.broadcast(of.agg(F.min("c").alias("least")))).select("source", (F.col("least") / F.col("c")).alias("rate")))
    return docs.join(ranks.sided(of), "source").where(_draw("doc_id") < F.col("rate")).select("doc_id", "source")


#: Shares of characters that languages are brought to.
TARGET_MIX = {"en": 40, "de": 30, "fr": 20, "es": 10}


def target_mix(spark, sf_dir):
    """Documents kept so that languages have their target shares of characters in expectation, as many as that allows; others go."""
    docs = _docs(spark, sf_dir).select("doc_id", "lang", "n_chars")
    goal = F.element_at(F.create_map(*[F.lit(x) for k, v in TARGET_MIX.items() for x in (k, float(v))]), F.col("lang"))
    of = docs.where(F.col("lang").isin(*TARGET_MIX)).groupBy("lang").agg(F.sum("n_chars").alias("c")).withColumn("room", F.col("c") / goal)
    of = of.crossJoin(F.broadcast(of.agg(F.min("room").alias("least")))).select("lang", (F.col("least") / F.col("room")).alias("rate"))  # a row for each target
    return docs.join(F.broadcast(of), "lang").where(_draw("doc_id") < F.col("rate")).select("doc_id", "lang")


def curriculum(spark, sf_dir):
    """Each source's documents in ten steps from short to long."""
    ranked = ranks.positions(_docs(spark, sf_dir).select("doc_id", "source", "n_chars"), "source", ["n_chars", "doc_id"])
    return ranked.select("doc_id", "source", ranks.ntile(F.col("position"), F.col("size"), 10).alias("step"))


SCRIPTS = {"latin": "Latin", "devanagari": "Devanagari", "telugu": "Telugu", "tamil": "Tamil", "cyrillic": "Cyrillic", "greek": "Greek", "han": "Han"}


def script_id(spark, sf_dir):
    """The script most of a text's letters are in (the first of ties), its share, and whether another has a fifth of them."""
    t = F.col("text")
    # ASCII's letters are Latin; the rest, mostly short, is looked at for each script. Counts are lengths of what is left, not of lists of matches
    docs = _docs(spark, sf_dir).select("doc_id", tx.left_of(t, "[^A-Za-z]").alias("ascii"), F.regexp_replace(t, r"[\x00-\x7F]+", "").alias("rest"))
    n = {k: tx.left_of(F.col("rest"), rf"\P{{Is{s}}}") + (F.col("ascii") if k == "latin" else 0) for k, s in SCRIPTS.items()}
    found = docs.select("doc_id", *(c.alias(k) for k, c in n.items()))
    every = sum((F.col(k) for k in SCRIPTS), F.lit(0))
    rank = F.sort_array(F.array(*SCRIPTS), asc=False)
    found = found.withColumn("letters", every).withColumn("r", rank)
    name = F.coalesce(*[F.when(F.col(k) == F.col("r")[0], F.lit(k)) for k in SCRIPTS])
    share = lambda k: F.col("r")[k] / F.col("letters")
    some = F.col("letters") > 0
    return found.select("doc_id", "letters", F.when(some, name).alias("script"), F.round(F.when(some, share(0)).otherwise(0.0), 6).alias("share"), F.when(some, share(1) >= 0.2).otherwise(False).alias("mixed"))


ALLOWED = ("MIT", "Apache", "BSD", "ISC", "CC0", "CC BY")
_NAMED = r"(?i)(?:licensed under|released under|SPDX-License-Identifier:?)\s+(?:the\s+)?(MIT|Apache|BSD|ISC|CC0|CC BY-NC|CC BY-SA|CC BY-ND|CC BY|GNU|GPL|LGPL|AGPL|Mozilla|MPL)"


def license_gate(spark, sf_dir):
    """The license a text names, and whether it may be used: named and allowed, named and not allowed, or not named."""
    name = F.regexp_extract("text", _NAMED, 1)
    state = F.when(name == "", "none").when(name.isin(*ALLOWED), "allowed").otherwise("denied")
    return _docs(spark, sf_dir).select("doc_id", F.nullif(name, F.lit("")).alias("license"), state.alias("state"))


def code_gates(spark, sf_dir):
    """What a reader of source files would be asked first: line lengths, share of letters, balance of brackets, marks of generated or test code."""
    t = F.col("text")
    n = lambda p: F.regexp_count(t, F.lit(p)).cast("bigint")
    lines = F.split(t, "\n")
    longest = F.array_max(F.transform(lines, lambda x: F.length(x))).cast("bigint")
    got = _docs(spark, sf_dir).select(
        "doc_id", F.size(lines).cast("bigint").alias("lines"), longest.alias("longest"), F.round(F.coalesce(F.try_divide(n(r"[A-Za-z]").cast("double"), F.length(t)), F.lit(0.0)), 6).alias("letters"),
        (n(r"[({\[]") == n(r"[)}\]]")).alias("balanced"), t.rlike(r"(?i)auto-?generated|do not edit").alias("generated"), t.rlike(r"\bassert\b|def test_|@Test|unittest").alias("tested"), n(r"[{};]").alias("marks"),
    )
    return got.withColumn("passed", (F.col("longest") <= 1000) & (F.col("letters") >= 0.25) & F.col("balanced") & ~F.col("generated"))


QUOTES = ("‘’‚“”„«»‹›", "\'\'\'\"\"\"\"\"\'\'")
DIGITS = ("०१२३४५६७८९౦౧౨౩౪౫౬౭౮౯௦௧௨௩௪௫௬௭௮௯", "0123456789" * 3)


def plain_marks(spark, sf_dir):
    """Quotation marks and Indic digits as ASCII's, each run of blanks as one; joiners stay."""
    plain = F.translate(F.translate("text", *QUOTES), *DIGITS)
    return _docs(spark, sf_dir).select("doc_id", F.md5(F.regexp_replace(plain, "[ \t]+", " ")).alias("md5"), F.length(plain).cast("bigint").alias("chars"))


def floored_documents(spark, sf_dir):
    """Documents that reach their language's threshold; where fewer than half would, as many of the longest as make half."""
    docs = _docs(spark, sf_dir).select("doc_id", "lang", "n_chars")
    good = docs.join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id")
    limit = good.groupBy("lang").agg(F.percentile("n_chars", 0.1).alias("threshold"))
    half = docs.groupBy("lang").agg(F.percentile("n_chars", 0.5).alias("half"))
    both = written(half.join(limit, "lang").select("lang", F.least("threshold", "half").alias("least")))
    return docs.join(ranks.sided(both), "lang").where(F.col("n_chars") >= F.col("least")).select("doc_id", "lang")


def held_out(spark, sf_dir):
    """Contents of the training ids that the held-out ids (every fifth) hold, too, and how many each side has: they should be none."""
    docs = _docs(spark, sf_dir).select((F.col("doc_id") % 5 == 0).alias("held"), F.md5("text").alias("md5"))
    train, held = (docs.where(c).select("md5") for c in ("NOT held", "held"))
    shared = train.intersect(held)
    only = lambda a, b, name: a.exceptAll(b).agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    return shared.agg(F.count("*").alias("n")).select(F.lit("shared").alias("what"), "n").unionByName(only(train, held, "train")).unionByName(only(held, train, "held"))


def paragraphs(spark, sf_dir):
    """Texts cut where blank lines part them, and long paragraphs into windows of 200 words: chunks keep to the structure."""
    parts = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", r"\n[ \t]*\n\s*")).alias("paragraph", "p"))
    words = parts.select("doc_id", "paragraph", F.regexp_extract_all("p", F.lit(r"[^ \t\n\r\f]+"), F.lit(0)).alias("w")).where("size(w) > 0")
    cut = words.select("doc_id", "paragraph", "w", F.explode(F.sequence(F.lit(0), F.ceil(F.size("w") / CHUNK).cast("int") - 1)).alias("chunk"))
    part = F.slice("w", F.col("chunk") * CHUNK + 1, CHUNK)
    return cut.select("doc_id", "paragraph", "chunk", F.size(part).cast("bigint").alias("words"), F.md5(F.array_join(part, " ")).alias("md5"))


def conversation_checks(spark, sf_dir):
    """Turns in order, whether user and assistant alternate, and the text that goes to training."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    roles = F.filter(F.transform("t", lambda x: x["role"]), lambda r: r != "system")
    flips = F.forall(F.zip_with(F.slice(roles, F.lit(1), F.greatest(F.lit(0), F.size(roles) - 1)), F.slice(roles, F.lit(2), F.greatest(F.lit(0), F.size(roles) - 1)), lambda a, b: a != b), lambda x: x)
    return turns.select(
        "conv_id", F.size("t").cast("bigint").alias("turns"), flips.alias("alternates"),
        F.md5(F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n")).alias("md5"),
    )


def chunks(spark, sf_dir):
    """Windows of 200 words every 150; the last one may be shorter."""
    words = F.regexp_extract_all("text", F.lit(r"[^ \t\n\r\f]+"), F.lit(0))
    docs = _docs(spark, sf_dir).select("doc_id", words.alias("w")).where("size(w) > 0")
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - CHUNK) / STRIDE)).cast("int")
    cut = docs.select("doc_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    part = F.slice("w", F.col("chunk") * STRIDE + 1, CHUNK)
    return cut.select("doc_id", "chunk", F.size(part).cast("bigint").alias("words"), F.md5(F.array_join(part, " ")).alias("md5"))


def benchmark_gates(spark, sf_dir):
    """Mean of each label against its gate, with the exact-match style count."""
    labels = table(spark, sf_dir, "labels")
    long = labels.select(F.explode(F.array(F.struct(F.lit("quality").alias("metric"), F.col("quality").alias("v"), F.lit(0.8).alias("gate")), F.struct(F.lit("clean").alias("metric"), (1 - F.col("toxic")).alias("v"), F.lit(0.95).alias("gate")))).alias("x")).select("x.*")
    return long.groupBy("metric", "gate").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean")).withColumn("passed", F.col("mean") >= F.col("gate"))


QUERIES = {
    f.__name__: f
    for f in (
        content_hashes, provenance, language_id, exact_dedup, known_bad_removed, split_overlap, line_dedup, minhash_pairs, minhash_groups, benchmark_overlap, quality_features,
        calibrated_thresholds, redacted, rebalanced, target_mix, curriculum, script_id, license_gate, code_gates, plain_marks, floored_documents, held_out,
        paragraphs, conversation_checks, chunks, benchmark_gates,
    )
}

_LIC = "regexp_matches(text, '(?i)licensed under|released under|SPDX-License-Identifier')"
_SEC = "regexp_matches(text, '" + tx.SECRET.replace("'", "''") + "')"
_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_RUNS = f"SELECT %s, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS g FROM (SELECT %s, {_WORDS} AS w FROM %s) WHERE len(w) >= 13"
_RED = "text"
for _k, _p in tx.PII:
    _RED = f"regexp_replace({_RED}, '{_p}', '<{_k}>', 'g')"
_TOKENS = r"list_transform(regexp_extract_all(lower(text), '[\p{L}\p{M}\x{200C}\x{200D}]+|\p{N}+|[^\p{L}\p{M}\p{N}\p{Z}\s]'), lambda x: x)"
_STOPS = ", ".join(f"len(list_filter(w, lambda x: list_contains({list(ws)}, x))) AS {c}" for c, ws in STOP.items())
#: All pairs by shared shingles: the bands must lose none of these tables'.
_NEAR = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w FROM documents),
g AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS g FROM w WHERE len(w) > 0),
h AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY g) AS content, count(*) OVER (PARTITION BY g) AS copies FROM g),
s AS (SELECT doc_id, unnest(g) AS g FROM g JOIN h USING (doc_id) WHERE doc_id = content), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id < y.doc_id GROUP BY ALL),
j AS (SELECT a, b, round(c / (na.n + nb.n - c), 6) AS jaccard FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE round(c / (na.n + nb.n - c), 6) >= 0.7),
e AS (SELECT a, b FROM j UNION SELECT b, a FROM j), r(x, y) AS (SELECT a, b FROM e UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y),
k AS (SELECT h.doc_id, coalesce(least(content, m), content) AS comp FROM h LEFT JOIN (SELECT x, min(y) AS m FROM r GROUP BY x) ON x = content)"""
ORACLES: dict[str, str] = {
    "content_hashes": f"SELECT doc_id, md5(text) AS md5, {_LIC} AS licensed, {_SEC} AS secret FROM documents",
    "provenance": f"SELECT source, count(*) AS docs, sum(length(text))::BIGINT AS chars, sum({_LIC}::INT)::BIGINT AS licensed, sum({_SEC}::INT)::BIGINT AS secrets FROM documents GROUP BY source",
    "language_id": f"""SELECT doc_id, lang, CASE WHEN n > 0 THEN CASE best WHEN en THEN 'en' WHEN de THEN 'de' WHEN fr THEN 'fr' ELSE 'es' END END AS guess, round(CASE WHEN n > 0 THEN best / n ELSE 0 END, 6) AS confidence,
n = 0 OR best / n < 0.6 AS review FROM (SELECT *, greatest(en, de, fr, es) AS best, en + de + fr + es AS n FROM (SELECT doc_id, lang, {_STOPS} FROM (SELECT doc_id, lang, {_TOKENS} AS w FROM documents)))""",
    "exact_dedup": "SELECT md5(text) AS md5, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "known_bad_removed": "SELECT md5(text) AS md5, min(doc_id) AS doc_id FROM documents GROUP BY 1 HAVING count(*) = 1",
    "split_overlap": "SELECT md5(text) AS md5, count(DISTINCT source) AS sources, count(*) AS docs FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1",
    "line_dedup": r"""WITH l AS (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS line FROM (SELECT doc_id, string_split(text, E'\n') AS a FROM documents)),
often AS (SELECT line FROM l WHERE length(line) >= 20 GROUP BY line HAVING count(DISTINCT doc_id) > 5)
SELECT doc_id, md5(string_agg(line, E'\n' ORDER BY pos)) AS md5, count(*) AS lines FROM l WHERE line NOT IN (SELECT line FROM often) GROUP BY doc_id""",
    # all pairs by shared shingles: the bands must lose none of these tables'
    "minhash_pairs": f"{_NEAR} SELECT a, b, jaccard, comp FROM j JOIN k ON k.doc_id = a",
    "minhash_groups": f"""{_NEAR} SELECT h.doc_id, content, copies, coalesce(l.links, 0) AS links, k.comp FROM h JOIN k USING (doc_id)
LEFT JOIN (SELECT x AS content, count(*) AS links FROM (SELECT a AS x FROM j UNION ALL SELECT b FROM j) GROUP BY x) l USING (content)""",
    "benchmark_overlap": f"SELECT doc_id, count(*) AS runs FROM ({_RUNS % ('doc_id', 'doc_id', 'documents')}) WHERE g IN (SELECT g FROM ({_RUNS % ('item_id', 'item_id', 'benchmark')})) GROUP BY doc_id",
    "quality_features": rf"""WITH w AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest({_WORDS}) AS w FROM documents) GROUP BY ALL), m AS (SELECT w, -ln(sum(n) / (SELECT sum(n) FROM w)) AS nll FROM w GROUP BY w),
s AS (SELECT doc_id, round(sum(n * nll) / sum(n), 6) AS nll, sum(n)::BIGINT AS words, count(*) AS distinct_words FROM w JOIN m USING (w) GROUP BY doc_id)
SELECT doc_id, len(regexp_extract_all(text, '[^\p{{L}}\p{{N}}\s]')) AS symbols, len(regexp_extract_all(text, '[A-Z]')) AS capitals, len(string_split(text, E'\n')) AS lines, nll, words, distinct_words FROM documents LEFT JOIN s USING (doc_id)""",
    "calibrated_thresholds": """WITH t AS (SELECT lang, round(quantile_cont(n_chars, 0.1), 6) AS threshold, count(*) AS good FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY lang)
SELECT lang, threshold, good, kept, docs, kept * 2 >= docs AS floor_met FROM t JOIN (SELECT lang, count(*) FILTER (n_chars >= threshold) AS kept, count(*) AS docs FROM documents JOIN t USING (lang) GROUP BY lang) USING (lang)""",
    "redacted": f"SELECT doc_id, md5({_RED}) AS md5, {', '.join(f"len(regexp_extract_all(text, '{p}')) AS {k}" for k, p in tx.PII)} FROM documents",
    "rebalanced": """SELECT doc_id, source FROM documents JOIN (SELECT source, min(sum(n_chars)) OVER () / sum(n_chars) AS rate FROM documents GROUP BY source) USING (source)
WHERE CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < rate""",
    "target_mix": f"""SELECT doc_id, lang FROM documents JOIN (SELECT lang, min(sum(n_chars) / any_value(goal)) OVER () / (sum(n_chars) / any_value(goal)) AS rate FROM documents
JOIN (VALUES {", ".join(f"('{k}', {v}.0::DOUBLE)" for k, v in TARGET_MIX.items())}) g(lang, goal) USING (lang) GROUP BY lang) USING (lang) WHERE CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < rate""",
    "script_id": f"""SELECT doc_id, letters, CASE WHEN letters > 0 THEN CASE r[1] {" ".join(f"WHEN {k} THEN '{k}'" for k in SCRIPTS)} END END AS script, round(CASE WHEN letters > 0 THEN r[1] / letters ELSE 0 END, 6) AS share, letters > 0 AND r[2] / letters >= 0.2 AS mixed
FROM (SELECT *, {" + ".join(SCRIPTS)} AS letters, list_reverse_sort([{", ".join(SCRIPTS)}]) AS r FROM (SELECT doc_id, {", ".join(rf"len(regexp_extract_all(text, '\p{{{v}}}')) AS {k}" for k, v in SCRIPTS.items())} FROM documents))""",
    "license_gate": f"SELECT doc_id, nullif(l, '') AS license, CASE WHEN l = '' THEN 'none' WHEN l IN {ALLOWED} THEN 'allowed' ELSE 'denied' END AS state FROM (SELECT doc_id, regexp_extract(text, '{_NAMED}', 1) AS l FROM documents)",
    "code_gates": r"""SELECT *, longest <= 1000 AND letters >= 0.25 AND balanced AND NOT generated AS passed FROM (SELECT doc_id, len(string_split(text, E'\n')) AS lines, list_max(list_transform(string_split(text, E'\n'), lambda x: length(x))) AS longest,
round(coalesce(len(regexp_extract_all(text, '[A-Za-z]')) / nullif(length(text), 0), 0)::DOUBLE, 6) AS letters, len(regexp_extract_all(text, '[({\[]')) = len(regexp_extract_all(text, '[)}\]]')) AS balanced,
regexp_matches(text, '(?i)auto-?generated|do not edit') AS generated, regexp_matches(text, '\bassert\b|def test_|@Test|unittest') AS tested, len(regexp_extract_all(text, '[{};]')) AS marks FROM documents)""",
    "plain_marks": f"""SELECT doc_id, md5(regexp_replace(t, '[ \t]+', ' ', 'g')) AS md5, length(t) AS chars FROM (SELECT doc_id, translate(translate(text, '{QUOTES[0]}', '{QUOTES[1].replace("'", "''")}'), '{DIGITS[0]}', '{DIGITS[1]}') AS t FROM documents)""",
    "floored_documents": """WITH t AS (SELECT lang, quantile_cont(n_chars, 0.1) AS threshold FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY lang), h AS (SELECT lang, quantile_cont(n_chars, 0.5) AS half FROM documents GROUP BY lang)
SELECT doc_id, lang FROM documents JOIN t USING (lang) JOIN h USING (lang) WHERE n_chars >= least(threshold, half)""",
    "held_out": """WITH t AS (SELECT md5(text) AS h FROM documents WHERE doc_id % 5 <> 0), e AS (SELECT md5(text) AS h FROM documents WHERE doc_id % 5 = 0)
SELECT 'shared' AS what, count(*) AS n FROM (SELECT h FROM t INTERSECT SELECT h FROM e) UNION ALL SELECT 'train', count(*) FROM (SELECT h FROM t EXCEPT ALL SELECT h FROM e) UNION ALL SELECT 'held', count(*) FROM (SELECT h FROM e EXCEPT ALL SELECT h FROM t)""",
    "paragraphs": rf"""SELECT doc_id, paragraph::INT AS paragraph, chunk::INT AS chunk, len(w[chunk * {CHUNK} + 1 : chunk * {CHUNK} + {CHUNK}]) AS words, md5(array_to_string(w[chunk * {CHUNK} + 1 : chunk * {CHUNK} + {CHUNK}], ' ')) AS md5 FROM (SELECT doc_id, paragraph, w, unnest(range(ceil(len(w) / {CHUNK})::BIGINT)) AS chunk
FROM (SELECT doc_id, unnest(range(len(a))) AS paragraph, regexp_extract_all(unnest(a), '[^ \t\n\r\f]+') AS w FROM (SELECT doc_id, string_split_regex(text, '\n[ \t]*\n\s*') AS a FROM documents)) WHERE len(w) > 0)""",
    "curriculum": "SELECT doc_id, source, ntile(10) OVER (PARTITION BY source ORDER BY n_chars, doc_id)::INT AS step FROM documents",
    "conversation_checks": r"""WITH c AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM conversations WHERE role <> 'system')
SELECT conv_id, turns, coalesce(alternates, true) AS alternates, md5 FROM (SELECT conv_id, count(*) AS turns, md5(string_agg(role || ': ' || text, E'\n' ORDER BY turn, role, text)) AS md5 FROM conversations GROUP BY conv_id)
LEFT JOIN (SELECT conv_id, bool_and(before IS NULL OR before <> role) AS alternates FROM c GROUP BY conv_id) USING (conv_id)""",
    "chunks": rf"""SELECT doc_id, chunk::INT AS chunk, len(w[chunk * {STRIDE} + 1 : chunk * {STRIDE} + {CHUNK}]) AS words, md5(array_to_string(w[chunk * {STRIDE} + 1 : chunk * {STRIDE} + {CHUNK}], ' ')) AS md5
FROM (SELECT doc_id, w, unnest(range(greatest(0, ceil((len(w) - {CHUNK}) / {STRIDE}))::BIGINT + 1)) AS chunk FROM (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r\f]+') AS w FROM documents) WHERE len(w) > 0)""",
    "benchmark_gates": "SELECT metric, gate::DOUBLE AS gate, n, mean, mean >= gate AS passed FROM (SELECT 'quality' AS metric, 0.8 AS gate, count(*) AS n, round(avg(quality), 6) AS mean FROM labels UNION ALL SELECT 'clean', 0.95, count(*), round(avg(1 - toxic), 6) FROM labels)",
}
