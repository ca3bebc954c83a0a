"""Spark-native pitch-tracking analytics engine."""
