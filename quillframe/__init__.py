"""Spark-native analytics over documents, pages and text lines."""
