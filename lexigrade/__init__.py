"""Spark-native retrieval and answer-evaluation engine."""
