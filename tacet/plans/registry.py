"""All queries of the engine, with their SQL where SQL can express them."""

from importlib import import_module

MODULES = ("rank_queries", "text_queries", "record_queries", "desk_queries", "open_queries")
QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"tacet.plans.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
