"""Registered queries over the driver tables, each with its SQL form where SQL can say it."""

from leadline.catalog import asof, cleaning, columns, demand, history, models, profile, promise, sales, validation  # noqa: F401
from leadline.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
