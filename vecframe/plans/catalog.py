"""All registered queries; importing this module fills the registry."""

from __future__ import annotations

from vecframe.plans import (  # noqa: F401
    eval_queries,
    rag_queries,
    report_queries,
    search_queries,
    suite_queries,
    text_queries,
    vector_queries,
)
from vecframe.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
