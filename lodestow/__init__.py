"""Spark-native file-catalog, matching, integrity and binary-transform engine."""
