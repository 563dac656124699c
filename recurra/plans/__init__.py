"""Registered queries by family."""
from .registry import REGISTRY, Query
from . import causal, chains, consolidate, gates, intervals, metrics, paired, recurrence, scalars, sequential, similarity, sources, streaming  # noqa: F401

__all__ = ["REGISTRY", "Query"]
