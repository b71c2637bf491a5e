"""Spark-native hybrid retrieval, code-graph analytics and corpus preparation."""
