"""Spark-native synthetic data, profiling and schema analysis."""

__version__ = "0.1.0"
