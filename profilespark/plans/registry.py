"""All registered queries and their SQL twins."""

from __future__ import annotations

from functools import wraps

from ..session import ready
from . import class_queries, core, curation_queries, model_queries, pair_queries, quality_queries, resolve_queries, scalar_queries, source_queries  # noqa: F401
from .register import QUERIES, oracles


def _tuned(fn):
    @wraps(fn)
    def run(spark, sf):
        ready(spark)
        return fn(spark, sf)

    return run


def flagship(spark, sf):
    return _tuned(QUERIES["gesd_calls"])(spark, sf)


def tuned(queries):
    """Queries that set up the session they are given before they run."""
    return {name: _tuned(fn) for name, fn in queries.items()}


def queries():
    return tuned(QUERIES)


def oracle_sql():
    return oracles()
