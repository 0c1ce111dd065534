"""All registered queries."""

from . import action_queries, check_queries, csv_queries, json_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
