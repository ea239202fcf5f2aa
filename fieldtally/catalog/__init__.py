"""Registered queries: each runs library operators on the driver's tables.

Where SQL can say the same, the SQL text next to the query is an independent check.
"""

from .registry import ORACLES, QUERIES
from . import scans, checks, scalars, joins, aggregates, profiles, windows, metrics, drift, models  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
