"""Spark-native engine for shared, changing tables."""
