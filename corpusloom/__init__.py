"""Spark-native analytics for multimodal training and evaluation corpora."""

__version__ = "0.1.0"
