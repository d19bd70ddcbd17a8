"""Queries of the library over the driver's tables."""

from newsgrid.plans import brief_queries, event_queries, library_queries, publish_queries, rank_queries, rule_queries, sink_queries, state_queries, story_queries, stream_queries, text_queries  # noqa: F401
from newsgrid.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
