"""Spark-native operators over spatial, hierarchical and event tables."""
