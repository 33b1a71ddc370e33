"""Spark-native classifier qualification and training-data preparation."""
