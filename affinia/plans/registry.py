"""All registered queries and their SQL."""

from __future__ import annotations

from affinia.plans import account_queries, map_queries, page_queries, store_queries, upkeep_queries
from affinia.plans.catalogue import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "account_queries", "map_queries", "page_queries", "store_queries", "upkeep_queries"]
