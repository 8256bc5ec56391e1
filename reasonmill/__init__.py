"""Spark-native preparation and scoring of structured reasoning traces."""

__version__ = "0.1.0"
