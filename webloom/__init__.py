"""Spark-native analytics over acquired web content."""
