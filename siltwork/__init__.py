"""Spark-native evaluation of large, noisy text collections."""
