"""Spark-native operators for strain surveillance data and for training-data work."""
