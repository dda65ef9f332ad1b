"""Spark-native operators for tabular model evaluation and training-data preparation."""
