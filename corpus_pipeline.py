"""The corpus pipeline: stages over ``documents``, each written and read again by the next.

Quality, near-duplicates, contamination and mixing drop documents and keep every column; the last stage
returns the token ids of what is left. A later stage sees only what its predecessors kept.

Every stage takes nulls in any column, empty and very long texts, repeated rows, an empty table and columns of any name; see the
stages for what they make of them.
"""

from __future__ import annotations

from corpusloom.llm import decontaminate, mixing, quality, simhash_dedup, tokens
from corpusloom.llm.common import dropped, read_table, written


def quality_stage(spark, docs, sf_dir):
    """Drops the documents that the classifier and their site's posterior reject.

    Null texts and texts without words are rejected. Null ids and repeated rows are judged as any other; a null source or lang is a site.
    """
    return quality.accepted(docs, read_table(spark, sf_dir, "labels"))


def simhash_stage(spark, docs, sf_dir):
    """Keeps one document of each near-duplicate group.

    Rows without an id or a text stay. Rows of one id are one document where their texts are equal, and documents of their own otherwise.
    """
    return simhash_dedup.keep_one(docs)


def decontamination_stage(spark, docs, sf_dir):
    """Drops the documents that share a span with the benchmark.

    Every row is judged by its own text, whatever its id; null texts stay. Null items and an empty benchmark drop nothing.
    """
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def mixing_stage(spark, docs, sf_dir):
    """Samples each source to its target share of tokens.

    Rows of one id, the null id too, stay or go together; a null source is a source; texts without words count no tokens.
    """
    return mixing.sample(docs)


def token_stage(spark, docs, sf_dir):
    """Encodes and compresses what is left.

    A row for each row of ``docs``, null texts with null codes, and a row of rules for each shard; nothing for an empty table.
    """
    return tokens.encoded(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", simhash_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
    ("token-id output", token_stage),
]
#: Logistic regression, bit sampling and balanced sampling have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage. A stage's table is deleted when the next one is written; the last one is read by the result."""
    docs = before = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
            dropped(before)
            before = docs
    return docs
