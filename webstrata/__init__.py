"""Spark-native analytics over versioned web captures."""
