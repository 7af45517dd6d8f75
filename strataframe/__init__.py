"""Spark-native analytics over semi-structured operational records and their documents."""

__version__ = "0.1.0"
