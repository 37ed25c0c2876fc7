"""Operators that prepare training text. Nothing else in the library imports this package."""

from leadline.llm.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
