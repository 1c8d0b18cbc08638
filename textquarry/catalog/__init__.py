"""Registered queries over the given tables, with DuckDB SQL that states the same result."""

from textquarry.catalog.base import ORACLE, QUERIES

from textquarry.catalog import files, chunks, terms, vectors, search, duplicates, context, lookups, changes, threads, streams  # noqa: E402,F401,I001

__all__ = ["ORACLE", "QUERIES"]
