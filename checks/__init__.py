"""Queries over the test tables, each checked against the same query in SQL."""

from checks import bronze, jobs, raw, registry, runs, silver  # noqa: F401
from checks.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
