"""Spark-native urban ecosystem analytics: pixel tables, block factors, scores, carbon, planting."""
