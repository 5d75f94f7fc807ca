"""Spark-native spatial scoring, ranking and evaluation engine."""

__version__ = "0.1.0"
