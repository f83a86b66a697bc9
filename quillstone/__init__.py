"""Spark-native hybrid search and text analytics."""
