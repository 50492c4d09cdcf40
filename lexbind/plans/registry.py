"""Queries of the engine and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("text_queries", "match_queries", "box_queries", "catalog_queries", "sampling_queries", "stream_queries")


def _merged(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(import_module(f"lexbind.plans.{module}"), name)
    return out


def queries() -> dict:
    """Query name -> function of (spark, sf_dir)."""
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    """Query name -> DuckDB SQL with the same result."""
    return _merged("SQL")
