"""Spark-native curation and evaluation analytics for instruction-tuning text."""

__version__ = "0.1.0"
