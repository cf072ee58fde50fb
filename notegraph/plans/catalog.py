"""All registered queries of the note-graph engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from notegraph.plans import graph_queries, search_queries, stream_queries, text_queries, vector_queries, view_queries

MODULES = (graph_queries, text_queries, search_queries, vector_queries, stream_queries, view_queries)


def _all() -> dict:
    found: dict = {}
    for m in MODULES:
        twice = found.keys() & m.QUERIES.keys()
        if twice:
            raise ValueError(f"registered twice: {sorted(twice)}")
        found |= m.QUERIES
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for k, (_, q) in _all().items() if q is not None}
