"""Queries over the test tables, with their SQL."""

from __future__ import annotations

from tidewright.plans import decisions, feeds, learned, market, rules, text, trades
from tidewright.plans.catalog import QUERIES, SQL, Query

__all__ = ["all_queries", "all_sql", "decisions", "feeds", "learned", "market", "rules", "text", "trades"]


def all_queries() -> dict[str, Query]:
    return QUERIES


def all_sql() -> dict[str, str]:
    return SQL
