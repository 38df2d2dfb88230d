"""Registered queries, grouped by family."""

from tidemark.plans import (  # noqa: F401
    aggregates,
    audits,
    files,
    generated,
    ingest,
    joins,
    messages,
    streams,
)
from tidemark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
