"""Spark-native corpus processing and retrieval evaluation."""
