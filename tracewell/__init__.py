"""Spark-native analytics for system logs: records, retrieval, scoring, metrics."""
