"""Spark-native analytics over open-data catalog metadata."""

__version__ = "0.1.0"
