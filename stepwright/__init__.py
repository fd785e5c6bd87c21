"""Spark-native analytics over agent-run archives."""

__version__ = "0.1.0"
