"""Spark-native analytics, text, retrieval and evaluation operators."""
