"""Spark-native analytics on paired events."""
