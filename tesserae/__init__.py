"""Spark-native analytics for gridded earth observation."""
