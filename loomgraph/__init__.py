"""Spark-native analytics over knowledge graphs, retrieval runs and answer trust."""
