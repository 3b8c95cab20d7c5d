"""Spark-native descriptor retrieval and evaluation."""
