"""Compositions of operators and the registry of queries."""

from wellspring.plans import (  # noqa: F401
    model_queries,
    split_queries,
    stream_queries,
    telemetry_queries,
    text_queries,
    window_queries,
)
from wellspring.plans.registry import QUERIES

__all__ = ["QUERIES"]
