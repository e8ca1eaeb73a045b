"""All registered queries and their checking SQL."""

from __future__ import annotations

from . import edge_queries, feature_queries, report_queries  # noqa: F401  (registration)
from .registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
