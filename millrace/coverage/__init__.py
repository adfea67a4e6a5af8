"""Coverage queries, one per operator, with their SQL twins."""

from . import (  # noqa: F401
    audit_queries,
    ingest_queries,
    relational_queries,
    scalar_queries,
    stream_queries,
    window_queries,
)
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
