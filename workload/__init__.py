"""Registered queries over the test tables, each with an equivalent SQL text."""

from . import catalog, cells, cleaning, compare, functions, joins, profile, quality, runs, steps  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
