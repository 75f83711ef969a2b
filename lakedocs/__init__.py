"""Spark-native document indexing and retrieval."""
