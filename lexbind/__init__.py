"""Spark-native label resolution engine."""
