"""Spark-native analytics engine."""
