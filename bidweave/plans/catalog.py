"""Every query with its SQL counterpart, collected from the modules of ``plans``."""

from __future__ import annotations

from bidweave.plans import extensions, mutations, payload_queries, relational, rule_queries, search, source_queries, text_queries  # noqa: F401
from bidweave.plans.registry import QUERIES

__all__ = ["QUERIES"]
