"""Every query over the given tables, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from . import coding_queries, interval_queries, more_queries, motif_queries, sequence_queries, summary_queries, window_queries
from .registry import QUERIES, SQL

FLAGSHIP = "join_overlap"
__all__ = ["FLAGSHIP", "QUERIES", "SQL", "coding_queries", "interval_queries", "more_queries", "motif_queries", "sequence_queries", "summary_queries", "window_queries"]
