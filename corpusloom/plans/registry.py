"""All queries of the engine by name, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from importlib import import_module

MODULES = ("text_plans", "bpe_plans", "curation_plans", "science_plans")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"corpusloom.plans.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
