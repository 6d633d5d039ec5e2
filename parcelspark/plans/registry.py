"""Queries and their SQL, gathered from the modules of plans/."""

from __future__ import annotations

from . import aggregates, extraction, joins, merging, reads, state  # noqa: F401  they register their queries
from .base import ORACLE_SQL, QUERIES  # noqa: F401
