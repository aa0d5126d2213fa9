"""Spark-native analytics for closed questions answered with probabilities."""

__version__ = "0.1.0"
