"""Queries that learn, apply and evaluate byte-pair merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import bpe, counts
from corpusloom.plans.text_plans import SQL
from corpusloom.sources.shared import written
from corpusloom.sources.tables import table

#: Tokens that training aims at, special ones and the alphabet counted: the reference's default.
VOCABULARY = 10_000


def _learned(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    words = written(counts.weighted_frequencies(docs))
    base = written(counts.base_vocabulary(words))
    # written: what reads the merges, twice or only some of them, doesn't run the training again
    merges = written(bpe.train(words, max(0, VOCABULARY - base.count()), known=tuple(counts.SPECIALS)))
    return docs, base, merges


def _trained(spark, sf_dir):
    docs, base, merges = _learned(spark, sf_dir)
    return docs, merges, bpe.Tokenizer.of(base, merges)


def bpe_merges(spark, sf_dir):
    return _learned(spark, sf_dir)[2]


def bpe_vocabulary(spark, sf_dir):
    tokenizer = _trained(spark, sf_dir)[2]
    return spark.createDataFrame(sorted(tokenizer.vocab.items(), key=lambda x: x[1]), "token string, id int")


def bpe_encoded(spark, sf_dir):
    docs, _, tokenizer = _trained(spark, sf_dir)
    return bpe.encode(docs.select("doc_id", "text"), tokenizer).select("doc_id", "ids", F.size("ids").alias("n_tokens"))


def bpe_roundtrip(spark, sf_dir):
    docs, _, tokenizer = _trained(spark, sf_dir)
    out = bpe.round_trip(docs.select("doc_id", "text"), tokenizer)
    return out.select("doc_id", F.md5("decoded").alias("decoded"), "same")


def bpe_evaluation(spark, sf_dir):
    docs, _, tokenizer = _trained(spark, sf_dir)
    return bpe.evaluate(docs, tokenizer)


def bpe_ratio_report(spark, sf_dir):
    docs, _, tokenizer = _trained(spark, sf_dir)
    return bpe.ratio_report(bpe.evaluate(docs, tokenizer), len(tokenizer.vocab))


def tokenized_requests(spark, sf_dir):
    """What a request gets: pretokens, tokens, ids and the text they decode to, of texts that a request may hold."""
    docs, _, tokenizer = _trained(spark, sf_dir)
    rows = bpe.tokenized(docs.select("doc_id", "text").where(F.length("text").between(1, 10_000)), tokenizer)
    return rows.select("doc_id", "pretokens", "pieces", "tokens", "ids", F.col("decoded").alias("decoded_text"))


def served_statistics(spark, sf_dir):
    """Tokens over faithful units of each language."""
    docs, _, tokenizer = _trained(spark, sf_dir)
    return bpe.served_statistics(docs, tokenizer)


def served_report(spark, sf_dir):
    """The same with the largest, the smallest, their difference and the score, in one row."""
    docs, _, tokenizer = _trained(spark, sf_dir)
    return bpe.full_report(bpe.served_statistics(docs, tokenizer), len(tokenizer.vocab))


def bpe_summary(spark, sf_dir):
    """The evaluation as lines of text, with the target of English."""
    docs, _, tokenizer = _trained(spark, sf_dir)
    reports = written(bpe.evaluate(docs, tokenizer))
    return bpe.summary(reports).join(bpe.language_gate(reports).select("language", "met"), "language", "left")


#: Times that training takes each language's texts.
COPIES = {"en": 2, "de": 3, "fr": 5, "es": 3}


def replicated_frequencies(spark, sf_dir):
    return counts.replicated_frequencies(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), COPIES)


def replicated_merges(spark, sf_dir):
    """Merges learned from texts that are there several times."""
    words = written(replicated_frequencies(spark, sf_dir))
    base = counts.base_vocabulary(words)
    return written(bpe.train(words, max(0, VOCABULARY - base.count()), at_least=1, known=tuple(counts.SPECIALS)))


QUERIES = {f.__name__: f for f in (bpe_merges, bpe_vocabulary, bpe_encoded, bpe_roundtrip, bpe_evaluation, bpe_ratio_report, tokenized_requests, served_statistics, served_report, bpe_summary, replicated_frequencies, replicated_merges)}
ORACLES: dict[str, str] = {
    "replicated_frequencies": f"SELECT word, sum(n * copies)::BIGINT AS freq FROM (SELECT lang, word, count(*) AS n FROM ({SQL['toks']}) GROUP BY lang, word) JOIN (VALUES {', '.join(f"('{k}', {v})" for k, v in COPIES.items())}) c(lang, copies) USING (lang) GROUP BY word",
    # every character is in the vocabulary, so what decoding gives back is known without the merges
    "bpe_roundtrip": r"""SELECT doc_id, md5(t) AS decoded, t = rtrim(regexp_replace(text, '[\s\x0B\x1c-\x1f\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1680}]+', ' ', 'g')) AS same FROM (SELECT doc_id, text,
regexp_replace(regexp_replace(text, '[\p{Z}\t\n\r\f\x0B]+$', ''), '[\p{Z}\t\n\r\f\x0B]+', ' ', 'g') AS t FROM documents)""",
}
