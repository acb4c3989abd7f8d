"""All queries of the library with their SQL."""

from __future__ import annotations

from sievework.plans import columns, design, evaluation, genes, more, relational  # noqa: F401
from sievework.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
