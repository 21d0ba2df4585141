"""Spark-native analytics for image-derived metadata."""
