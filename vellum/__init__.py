"""Spark-native analytics over document pages held as nested records."""
