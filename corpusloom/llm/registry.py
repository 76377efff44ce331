"""Queries and SQL twins of the training-data operators."""

from __future__ import annotations

from importlib import import_module

import corpus_pipeline

MODULES = (
    "simhash_dedup",
    "quality",
    "decontaminate",
    "mixing",
    "tokens",
    "toxicity",
    "pii",
    "secrets",
    "licenses",
    "embedding_dedup",
)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"corpusloom.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
