"""Spark-native time-series anomaly evidence engine."""

__version__ = "0.1.0"
