"""Spark-native analytics over panels of bars."""
