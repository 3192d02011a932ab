"""Queries and their SQL, by name."""

from __future__ import annotations

from quire.plans import relational  # noqa: F401  (adds its queries)
from quire.plans.queries import ORACLES, QUERIES

FLAGSHIP = "text_stream"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
