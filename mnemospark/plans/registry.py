"""Registered queries of the engine and their DuckDB counterparts."""

from __future__ import annotations

from . import relational, search


def queries():
    return dict(relational.QUERIES)


def oracle_sql():
    return dict(relational.SQL)


def flagship(spark, sf_dir):
    """Hybrid search of the benchmark queries over the documents."""
    return search.hybrid_search(spark, sf_dir)
