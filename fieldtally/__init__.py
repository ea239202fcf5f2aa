"""Batch risk-list and drift analytics for outreach programmes, on Spark."""

__version__ = "0.1.0"
