"""Spark-native analytics and retrieval over document collections."""
