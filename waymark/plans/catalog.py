"""All registered queries."""

from __future__ import annotations

from . import claims_queries, job_queries, more_queries, text_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
