"""Registration of queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from .views import oracle

QUERIES, _TWINS = {}, {}


def register(name, sql=None, **extra):
    """Adds a query; ``sql`` is its DuckDB twin over the shared views, ``extra`` are views of its own."""
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            _TWINS[name] = (sql, extra)
        return fn
    return deco


def oracles():
    return {name: oracle(sql, **extra) for name, (sql, extra) in _TWINS.items()}


def r(c, d=6):
    """Rounded column under its own name."""
    return F.round(F.col(c), d).alias(c)
