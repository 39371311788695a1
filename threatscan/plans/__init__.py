"""Registered queries over the shared tables."""

from __future__ import annotations


def all_queries() -> dict:
    """name -> (query, oracle SQL or None)."""
    from threatscan.plans import catalog, document_queries, office_queries, url_queries  # noqa: F401  registering

    return dict(catalog.CATALOG)
