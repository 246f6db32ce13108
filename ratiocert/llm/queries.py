"""All registered queries of this subpackage."""

from __future__ import annotations

from . import queries_a, queries_b, queries_c, queries_d  # noqa: F401
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
