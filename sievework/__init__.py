"""Spark-native curation, gating, sampling and evaluation of record corpora."""

__version__ = "0.1.0"
