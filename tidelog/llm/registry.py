"""The text operators' queries and their SQL."""

from __future__ import annotations

import importlib

MODULES = ["bpe", "quality_rules", "langid", "exact_dedup", "jaccard", "warc", "toxicity", "substrings", "packing", "nbsvm"]


def _all(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(importlib.import_module(f"tidelog.llm.{module}"), name)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLE")
