"""Spark-native analytics over dated, classed and located records."""
