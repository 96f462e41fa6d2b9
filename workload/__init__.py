"""Registered queries: importing the package fills the registry."""

from workload.registry import ORACLES, QUERIES
from workload import analysis_queries, compare_queries, sketch_queries, source_queries, step_queries  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
