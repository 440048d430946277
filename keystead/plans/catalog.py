"""All registered queries."""

from __future__ import annotations

from keystead.plans import (  # noqa: F401
    model_queries, page_queries, quality_queries, screen_queries, stream_queries, text_queries, value_queries,
)
from keystead.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
