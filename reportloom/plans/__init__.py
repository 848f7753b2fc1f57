"""Runnable queries over the given tables."""

from importlib import import_module

from reportloom.plans.registry import QUERIES, SQL

MODULES = [
    "text_queries",
    "corpus_queries",
    "dashboard_queries",
    "annotation_queries",
    "model_queries",
    "stream_queries",
]


def _load() -> None:
    for name in MODULES:
        import_module(f"reportloom.plans.{name}")


def all_queries() -> dict:
    _load()
    return dict(QUERIES)


def all_sql() -> dict:
    _load()
    return dict(SQL)
