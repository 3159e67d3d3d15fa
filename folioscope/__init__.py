"""Spark-native analytics over large collections of structured text documents."""

__version__ = "0.1.0"
