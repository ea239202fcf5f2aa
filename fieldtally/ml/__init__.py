"""Preparation, training, calibration, scoring and attribution on Spark ML."""
