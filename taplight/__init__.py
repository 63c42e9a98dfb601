"""Spark-native analytics over network telemetry."""
