"""Spark-native retrieval, graph and corpus-processing engine."""

__version__ = "0.1.0"
