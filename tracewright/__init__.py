"""Spark-native analytics over recorded, time-ordered telemetry and event data."""

__version__ = "0.1.0"
