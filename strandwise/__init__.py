"""Spark-native analytics for biological sequences: k-mers, sketches, similarity, statistics."""
