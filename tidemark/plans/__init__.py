"""The registered queries and their SQL."""

from tidemark.plans import bundle_queries, days, feature_queries, judgement, lookup_queries, report_queries, scan_queries, signal_queries, stream_queries, text_queries, time_queries  # noqa: F401
from tidemark.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
