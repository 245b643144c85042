"""Spark-native customer analytics over retail invoice lines."""
