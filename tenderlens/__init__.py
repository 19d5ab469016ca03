"""Spark-native procurement screening engine."""
