"""Spark-native scene analytics."""
