"""Operators for training text. Nothing outside this folder imports it; ``__spark_entry__`` adds its queries if it is there."""

from turnwise.llm.queries import queries
from turnwise.llm.sql import oracle_sql

__all__ = ["oracle_sql", "queries"]
