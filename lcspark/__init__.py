"""Spark-native analytics for LC-MS/MS study tables: tolerance joins, grouping, cleaning, MS2 scoring and data preparation."""
