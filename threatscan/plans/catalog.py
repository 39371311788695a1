"""Every registered query with its oracle: name -> (query, SQL or None)."""

from __future__ import annotations

CATALOG: dict = {}


def query(name, sql=None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with the DuckDB text ``sql``."""

    def put(fn):
        CATALOG[name] = (fn, sql)
        return fn

    return put
