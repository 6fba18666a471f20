"""All queries of this subpackage, with their SQL where SQL can express them."""

from importlib import import_module

MODULES = ("substring", "near", "lm", "packing", "quality", "classifier", "licences", "urls", "embeddings", "mixing", "infill", "runs", "exact")
QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"tacet.llm.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
