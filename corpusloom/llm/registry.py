"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("quality_rules", "pii", "licenses", "sentencepieces", "fingerprints", "warc", "lm_scoring", "ngram_join", "source_mixing", "url_filters", "fill_in_middle", "merkle", "substring_dedup")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"corpusloom.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for m in MODULES for k, sql in import_module(f"corpusloom.llm.{m}").ORACLES.items()}
