"""Spark-native analytics for content-extraction and text quality."""
