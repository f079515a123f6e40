"""Spark-native analytics over versioned text and source corpora."""

__version__ = "0.1.0"
