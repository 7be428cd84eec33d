"""Importing this module registers every query."""

from . import (  # noqa: F401
    q_classify,
    q_clean,
    q_entities,
    q_graph,
    q_joins,
    q_merge,
    q_sources,
    q_stats,
    q_stream,
    q_validate,
)
from .registry import CASES, Tables

FLAGSHIP = "retrieve"

__all__ = ["CASES", "FLAGSHIP", "Tables"]
