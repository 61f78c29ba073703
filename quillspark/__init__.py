"""Spark-native text proofreading analytics and training-data operators."""
