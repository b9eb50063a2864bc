"""Spark-native engine for auditing and building datasets of web records."""
