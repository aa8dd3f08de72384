"""Spark-native engine for image assets and the records of processing them."""
