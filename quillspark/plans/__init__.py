"""Registered queries and their SQL."""

from quillspark.plans import corpus_queries, evaluation_queries, harvest_queries, store_queries, stream_queries

_MODULES = [harvest_queries, evaluation_queries, corpus_queries, store_queries, stream_queries]


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
