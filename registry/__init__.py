"""Registered queries: one per operator, each over whole driver tables, with its SQL counterpart."""

from __future__ import annotations

from . import base
from . import aggregates, certificates, corpus, filters_joins, io, overlap, projections, scoring, tasks  # noqa: F401

QUERIES = base.QUERIES
SQL = base.SQL
