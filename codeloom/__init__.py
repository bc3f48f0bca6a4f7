"""Spark-native analytics over evidence-backed code graphs."""

__version__ = "0.1.0"
