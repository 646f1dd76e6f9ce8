"""All registered queries."""

from . import queries_models, queries_stats, queries_tables  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
