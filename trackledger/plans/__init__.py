"""The driver tables mapped to the domain, the registered queries and their SQL."""

from trackledger.plans import derive_queries, text_queries, other_queries, source_queries, view_queries  # isort: skip
from trackledger.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "derive_queries", "other_queries", "source_queries", "text_queries", "view_queries"]
