"""Spark-native analytics over infrastructure-project data."""
