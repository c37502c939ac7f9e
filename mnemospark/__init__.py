"""Spark-native engine for memory curation and hybrid retrieval."""
