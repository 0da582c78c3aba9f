"""Spark-native analytics for retrieval, memory, knowledge graphs and text corpora."""
