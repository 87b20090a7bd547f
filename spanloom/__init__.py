"""Spark-native analytics over text spans."""
