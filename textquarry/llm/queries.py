"""All registered queries of this subpackage."""

from textquarry.llm import queries_integrity, queries_joins, queries_native, queries_quality, queries_text  # noqa: F401
from textquarry.llm.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
