"""Operators bound to the driver's tables, each with its checking SQL."""

from tidemark.plans import cluster, models, panel, prep, study, tide  # noqa: F401  (registers queries)
from tidemark.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
